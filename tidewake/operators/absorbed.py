"""Fixed-effects regressions with one category of very many levels, which is absorbed and never a matrix.

The cells' cross products less those of the absorbed category's means are what least squares sees once its effects are
gone (Frisch, Waugh and Lovell): a unit's sums enter as one vector, and only the products of the other categories' few
levels, with the regressors, reach the driver.  The units' own effects and cluster scores stay in Spark as tables."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .regression import REFERENCES, SPECS, cells, normal_sf

#: Levels that all other categories may have together; the driver holds their products.
MOST_LEVELS = 2000


def _levels(at: DataFrame, names: list[str]) -> dict[str, list]:
    """The levels of each category but its reference."""
    out = {}
    for c in names:
        found = sorted(r[0] for r in at.select(c).distinct().limit(MOST_LEVELS + 1).collect())
        if sum(map(len, out.values())) + len(found) > MOST_LEVELS:
            raise ValueError(f"the categories beside the absorbed one have over {MOST_LEVELS} levels")
        first = REFERENCES.get(c) if REFERENCES.get(c) in found else found[0] if found else None
        out[c] = [v for v in found if v != first]
    return out


def _of_level(c: str, levels: list, values: list, kind: str) -> Column:
    """A number for each level of a category; NULL for the reference."""
    table = F.from_json(F.lit(json.dumps({str(k): v for k, v in zip(levels, values, strict=True)})), f"map<string,{kind}>")
    return F.try_element_at(table, F.col(c).cast("string"))


def _within(units: DataFrame, width: int, k: int) -> np.ndarray:
    """Sum over units of v v' / n, v being the unit's level counts and sums; summed up by task, then by cell of the matrix."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v = np.zeros((part.num_rows, width))
                counts = part.column("counts")
                row = np.repeat(np.arange(part.num_rows), np.diff(counts.offsets.to_numpy()))
                flat = counts.flatten()
                v[row, flat.field("j").to_numpy()] = flat.field("m").to_numpy()
                v[:, k:] = part.column("sums").flatten().to_numpy().reshape(-1, width - k)
                total += v.T @ (v / part.column("n").to_numpy()[:, None])
        yield pa.RecordBatch.from_pydict({"cell": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    told = units.select("n", "sums", "counts").mapInArrow(run, "cell array<double>").select(F.posexplode("cell").alias("i", "x"))
    out = np.zeros(width * width)
    for r in told.groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out.reshape(width, width)


def fit_absorbed(df: DataFrame, spec: str = "M4", absorb: str = "bmu") -> tuple[dict, DataFrame]:
    """As regression.fit() for a specification with `absorb` among its categories, standard errors clustered by it: the result, whose
    coefficients lack the absorbed effects, and those effects as a table (absorb, effect; const is not taken off)."""
    names, squared = SPECS[spec]
    if absorb not in names:
        raise ValueError(f"{spec} has no effects of {absorb}")
    at = staged(cells(df), "regression-cells")
    rest = [c for c in names if c != absorb]
    levels = _levels(at, rest)
    first = dict(zip(rest, np.cumsum([0, *[len(levels[c]) for c in rest]])[:-1].tolist(), strict=True))
    k = sum(map(len, levels.values()))
    places = [_of_level(c, levels[c], list(range(first[c], first[c] + len(levels[c]))), "int") for c in rest]
    at = at.withColumn("js", F.array_compact(F.array(*places)) if places else F.expr("cast(array() as array<int>)"))
    sums = ["x", *(["e"] if squared else []), "y"]
    width = k + len(sums)

    counts = at.select(absorb, "n", F.explode("js").alias("j")).groupBy(absorb, "j").agg(F.sum("n").cast("double").alias("m"))
    counts = counts.groupBy(absorb).agg(F.collect_list(F.struct("j", "m")).alias("counts"))  # a unit's levels: k at most
    units = at.groupBy(absorb).agg(F.sum("n").cast("double").alias("n"), F.array(*[F.sum(c) for c in sums]).alias("sums")).join(counts, absorb, "left")
    units = staged(units.withColumn("counts", F.coalesce("counts", F.expr("cast(array() as array<struct<j:int,m:double>>)"))), "regression-units")

    whole = np.zeros((width, width))
    for r in at.select("n", F.explode("js").alias("a"), "js").select("n", "a", F.explode("js").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        whole[r.a, r.b] = r.n
    for r in at.select(*sums, F.explode("js").alias("a")).groupBy("a").agg(*[F.sum(c).alias(c) for c in sums]).collect():
        whole[r.a, k:] = whole[k:, r.a] = [r[c] for c in sums]
    total = at.agg(F.sum("n").alias("n"), F.sum("y").alias("y"), *[F.sum(c).alias(f"{c}_") for c in ("xx", "xy", "yy", "xe", "ee", "ye")]).first()
    product = {("x", "x"): "xx_", ("x", "y"): "xy_", ("y", "y"): "yy_", ("e", "x"): "xe_", ("e", "e"): "ee_", ("e", "y"): "ye_"}
    for i, a in enumerate(sums):
        for j, b in enumerate(sums):
            whole[k + i, k + j] = total[product[tuple(sorted((a, b)))]]
    s = whole - _within(units, width, k)

    y, x = width - 1, k
    own = list(range(y))
    beta = np.linalg.pinv(s[:y, :y]) @ s[:y, y]
    others = [i for i in own if i != x]
    p = np.linalg.pinv(s[np.ix_(others, others)]) @ s[others, x] if others else np.zeros(0)
    spread = s[x, x] - p @ s[others, x]
    n_units, n = units.count(), total.n
    width_all = 1 + y + n_units - 1

    # the unit's own part of the fit, and of the regression of x on all else
    on_x = np.zeros(y)
    on_x[others] = p

    def unit_part(coefficients: np.ndarray, target: int) -> Column:
        table = F.array(*[F.lit(float(v)) for v in coefficients[:k]], F.lit(0.0))
        levels_part = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c["m"] * F.get(table, c["j"]))
        more = sum((F.lit(float(coefficients[i])) * F.get("sums", F.lit(i - k)) for i in range(k, y) if i != target), F.lit(0.0))
        return (F.get("sums", F.lit(target - k)) - levels_part - more) / F.col("n")

    effects = units.select(absorb, unit_part(beta, y).alias("effect"), unit_part(on_x, x).alias("on_x"))

    def level_part(coefficients: np.ndarray) -> Column:
        return sum((F.coalesce(_of_level(c, levels[c], coefficients[first[c] : first[c] + len(levels[c])].tolist(), "double"), F.lit(0.0)) for c in rest), F.lit(0.0))

    cell = at.drop("js").join(effects, absorb).withColumn("w", F.col("effect") + level_part(beta)).withColumn("t", F.col("on_x") + level_part(on_x))
    b, g, q = float(beta[x]), float(beta[k + 1]) if squared else 0.0, float(on_x[k + 1]) if squared else 0.0
    c = F.col
    score = c("xy") - b * c("xx") - g * c("xe") - c("w") * c("x") - q * (c("ye") - b * c("xe") - g * c("ee") - c("w") * c("e")) - c("t") * (c("y") - b * c("x") - g * c("e") - c("n") * c("w"))
    meat = cell.groupBy(absorb).agg(F.sum(score).alias("s")).agg(F.sum(c("s") * c("s"))).first()[0]
    se = float(np.sqrt(max(meat, 0.0) * n_units / max(1, n_units - 1) * (n - 1) / (n - width_all)) / spread)
    fit_loss, z = s[y, y] - beta @ s[:y, y], 1.959963984540054
    r2 = 1 - fit_loss / (total["yy_"] - total.y**2 / n)
    labels = [*[f"{c_}={v}" for c_ in rest for v in levels[c_]], "log_effort", *(["effort_sq"] if squared else [])]
    result = {
        "spec": spec, "beta": b, "se": se, "p": normal_sf(b / se) if se else 0.0, "low": b - z * se, "high": b + z * se, "r2": float(r2),
        "adj_r2": float(1 - (1 - r2) * (n - 1) / (n - width_all)), "n": int(n), "coefficients": dict(zip(labels, beta.tolist(), strict=True)),
    }
    return result, effects.select(absorb, "effect")
