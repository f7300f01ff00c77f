"""Support vectors under a radial kernel with probabilities, for training tables of any size.

The kernel is taken at landmarks (Nystroem features), so that each pair of classes is a linear machine over them, fitted by
Spark ML.  Platt's sigmoids turn decisions into probabilities of pairs, coupled to one for each class by Price's formula.
Prediction is SQL alone: kernel values at the landmarks, one weighted sum for each pair."""

from __future__ import annotations

import json
from itertools import combinations
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows looked at when landmarks are chosen: those of smallest hash, so that every run takes the same.
LANDMARK_SAMPLE = 4_000
ROUNDS = 30


def literal(value, schema: str) -> str:
    """SQL for a constant of numbers and strings."""
    text = json.dumps(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"from_json('{text}', '{schema}')"


def _dot(a: str, b: str, start: str = "0D") -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), {start}, (s, v) -> s + v)"


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(2))


def pivots(x: np.ndarray, n: int, gamma: float, least: float = 1e-9) -> np.ndarray:
    """Rows of x by pivoted incomplete Cholesky: the next is the row with the largest part that those before don't explain."""
    left, factor, chosen = np.ones(len(x)), np.zeros((len(x), 0)), []
    while len(chosen) < min(n, len(x)) and left.max() > least:
        i = int(left.argmax())
        column = (kernel(x, x[i : i + 1], gamma)[:, 0] - factor @ factor[i]) / left[i] ** 0.5
        factor, left = np.column_stack([factor, column]), np.maximum(left - column**2, 0)
        chosen.append(i)
    return x[chosen]


def landmarks(rows: DataFrame, features: list[str], n: int, gamma: float) -> np.ndarray:
    """n pivots at most out of LANDMARK_SAMPLE different rows."""
    held = rows.select(*features).distinct().orderBy(F.xxhash64(*features), *features).limit(LANDMARK_SAMPLE).collect()  # bounded
    return pivots(np.array([list(map(float, r)) for r in held]).reshape(-1, len(features)), n, gamma)


def lifted(root: np.ndarray):
    """A function of kernel values: their Nystroem features, a matrix product for each batch (in SQL, as many steps a row as the
    square of the landmarks)."""

    @F.pandas_udf("array<double>")
    def lift(k: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(k.to_list()) @ root.T) if len(k) else [], dtype=object)

    return lift


class KernelMachine:
    """One machine for each pair of the classes 0..k-1 in `label`; stages() are Spark ML transformers that add _k (kernel values),
    _f (decisions by pair), _prob (by class, sums to 1) and _guess (most pairs won, the smaller class on ties).

    A fifth of the rows, by hash of their features, isn't trained on when the sigmoids are fitted; a pair that lacks a class in that
    fifth or outside of it is fitted and judged on all its rows.  The machines kept are those of all rows."""

    def __init__(self, features: list[str], gamma: float, cost: float = 1.0, size: int = 64, parallelism: int = 8):
        self.features, self.gamma, self.cost, self.size, self.parallelism = features, gamma, cost, size, parallelism

    def _kernel(self) -> SQLTransformer:
        far = " + ".join(f"({c} - c[{i}]) * ({c} - c[{i}])" for i, c in enumerate(self.features))
        points = literal(self.points.tolist(), "array<array<double>>")
        return SQLTransformer(statement=f"SELECT *, transform({points}, c -> exp({-self.gamma!r} * ({far}))) AS _k FROM __THIS__")

    @staticmethod
    def _decisions(machines: list[dict]) -> str:
        return f"transform({literal(machines, 'array<struct<w: array<double>, b: double>>')}, m -> {_dot('m.w', '_k', 'm.b')})"

    def fit(self, rows: DataFrame, label: str, classes: int) -> KernelMachine:
        self.points = landmarks(rows, self.features, self.size, self.gamma)
        self.classes, self.pairs = classes, list(combinations(range(classes), 2))
        values, vectors = np.linalg.eigh(kernel(self.points, self.points, self.gamma))
        keep = values > 1e-10 * values.max()
        self.root = (vectors[:, keep] / np.sqrt(values[keep])).T
        at = self._kernel().transform(rows).withColumn("_phi", array_to_vector(lifted(self.root)("_k")))
        at = at.select(F.col(label).alias("_c"), "_k", "_phi", (F.pmod(F.xxhash64(*self.features), F.lit(5)) == 0).alias("_out")).persist()
        counts = {(int(r["_c"]), r["_out"]): r["n"] for r in at.groupBy("_c", "_out").agg(F.count("*").alias("n")).collect()}
        split = [all(counts.get((c, side), 0) for c in p for side in (True, False)) for p in self.pairs]
        whole = [(at, p, sum(counts.get((c, s), 0) for c in p for s in (True, False))) for p in self.pairs]
        parts = [(at.where("NOT _out"), p, sum(counts.get((c, False), 0) for c in p)) for p, s in zip(self.pairs, split, strict=True) if s]
        with ThreadPool(self.parallelism) as pool:  # as Spark ML's own estimators fit several models
            fitted = pool.map(inheritable_thread_target(rows.sparkSession)(lambda job: self._machine(*job)), whole + parts)
        self.machines, rest = fitted[: len(whole)], iter(fitted[len(whole) :])
        tried = [next(rest) if s else m for s, m in zip(split, self.machines, strict=True)]
        self.sigmoids = self._sigmoids(at, tried, split, counts)
        at.unpersist()
        return self

    def _machine(self, at: DataFrame, pair: tuple[int, int], n: int) -> dict:
        of = at.where(F.col("_c").isin(*pair)).withColumn("_y", (F.col("_c") == pair[0]).cast("double"))
        svc = LinearSVC(featuresCol="_phi", labelCol="_y", regParam=1 / (self.cost * max(n, 1)), maxIter=50, tol=1e-4, standardization=False).fit(of)
        return {"w": (self.root.T @ svc.coefficients.toArray()).tolist(), "b": float(svc.intercept)}

    def _sigmoids(self, at: DataFrame, machines: list[dict], split: list[bool], counts: dict) -> list[list[float]]:
        """Platt's (A, B) of all pairs by Newton's method, one aggregate a round; a step that makes a pair worse is halved."""
        if not self.pairs:
            return []
        size = lambda c, s: counts.get((c, True), 0) + (0 if s else counts.get((c, False), 0))
        sides = [{"i": i, "j": j, "s": s, "n": size(i, s), "m": size(j, s)} for (i, j), s in zip(self.pairs, split, strict=True)]
        pairs = literal(sides, "array<struct<i: int, j: int, s: boolean, n: long, m: long>>")
        rows = at.select("_c", "_out", F.posexplode(F.expr(self._decisions(machines))).alias("_p", "f")).withColumn("q", F.expr(f"{pairs}[_p]"))
        rows = rows.where("(_c = q.i OR _c = q.j) AND (_out OR NOT q.s)")
        rows = rows.selectExpr("_p", "f", "CASE WHEN _c = q.i THEN (q.n + 1D) / (q.n + 2D) ELSE 1D / (q.m + 2D) END AS t").persist()
        best = [[0.0, float(np.log((s["m"] + 1) / (s["n"] + 1)))] for s in sides]
        now, step, loss, done = [list(b) for b in best], [np.zeros(2) for _ in best], [np.inf] * len(best), [False] * len(best)
        for _ in range(ROUNDS):
            at_now = rows.withColumn("_ab", F.expr(f"{literal(now, 'array<array<double>>')}[_p]")).selectExpr("*", "_ab[0] * f + _ab[1] AS z")
            at_now = at_now.selectExpr("*", "1 / (1 + exp(least(z, 700D))) AS p")
            sums = at_now.groupBy("_p").agg(
                F.expr("sum(greatest(z, 0D) + log1p(exp(-abs(z))) - (1 - t) * z) AS loss"), F.expr("sum(f * (t - p)) AS ga"), F.expr("sum(t - p) AS gb"),
                F.expr("sum(f * f * p * (1 - p)) AS haa"), F.expr("sum(f * p * (1 - p)) AS hab"), F.expr("sum(p * (1 - p)) AS hbb"),
            ).collect()  # a row for each pair
            for r in sums:
                k = r["_p"]
                if done[k]:
                    continue
                if r["loss"] <= loss[k] + 1e-12 * abs(r["loss"]):
                    done[k] = loss[k] - r["loss"] < 1e-9 * (1 + abs(r["loss"]))
                    best[k], loss[k] = list(now[k]), r["loss"]
                    h = np.array([[r["haa"] + 1e-12, r["hab"]], [r["hab"], r["hbb"] + 1e-12]])
                    step[k] = -np.linalg.solve(h, [r["ga"], r["gb"]])
                else:
                    step[k] = step[k] / 2
                now[k] = list(best[k]) if done[k] else [float(v) for v in np.array(best[k]) + step[k]]
            if all(done[r["_p"]] for r in sums):
                break
        rows.unpersist()
        return best

    def stages(self) -> list[SQLTransformer]:
        if not self.pairs:
            return [SQLTransformer(statement="SELECT *, array(1D) AS _prob, 0D AS _guess FROM __THIS__")]
        pairs = literal([{"i": i, "j": j} for i, j in self.pairs], "array<struct<i: int, j: int>>")
        sigmoid = f"zip_with(_f, {literal(self.sigmoids, 'array<array<double>>')}, (f, s) -> least(greatest(1 / (1 + exp(least(s[0] * f + s[1], 700D))), 1e-7D), 1 - 1e-7D))"
        every = f"sequence(0, {self.classes - 1})"
        odds = f"aggregate(zip_with({pairs}, _r, (p, r) -> CASE WHEN p.i = c THEN 1 / r WHEN p.j = c THEN 1 / (1 - r) ELSE 0D END), 0D, (s, v) -> s + v)"
        won = f"size(filter(zip_with({pairs}, _f, (p, f) -> CASE WHEN f > 0 THEN p.i ELSE p.j END), w -> w = c))"
        return [
            self._kernel(),
            SQLTransformer(statement=f"SELECT *, {self._decisions(self.machines)} AS _f FROM __THIS__"),
            SQLTransformer(statement=f"SELECT *, {sigmoid} AS _r, transform({every}, c -> {won}) AS _won FROM __THIS__"),
            SQLTransformer(statement=f"SELECT *, transform({every}, c -> 1 / ({odds} - {self.classes - 2})) AS _part FROM __THIS__"),
            SQLTransformer(statement="SELECT *, transform(_part, v -> v / aggregate(_part, 0D, (s, x) -> s + x)) AS _prob, CAST(array_position(_won, array_max(_won)) - 1 AS DOUBLE) AS _guess FROM __THIS__"),
        ]
