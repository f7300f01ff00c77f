"""Self-organising maps of whole tables by batch training.

A round is one aggregate: each row's nearest node, and by node the rows' count and sums.  The driver, which holds the nodes
only, moves every node to the mean of all rows weighted by a Gaussian of the distance on the map between it and their
nearest nodes; the Gaussian narrows from round to round.  Nodes start on the plane of the rows' two largest principal
components, so that nothing is drawn and rows in any order give the same map."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import staged


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns less their mean, over their population deviation (0 where all rows are equal)."""
    r = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(r[f"m{i}"])) / F.lit(r[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)


def _nearest(x: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, least = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    columns = [np.ascontiguousarray(v) for v in x.T]
    for k, w in enumerate(nodes):  # one node at a time: memory is a batch's, whatever the map's size
        d = np.zeros(len(x))
        for v, c in zip(columns, w, strict=True):
            d += (v - c) ** 2
        near = d < least
        best[near], least[near] = k, d[near]
    return best, np.sqrt(least)


class BatchMap:
    """fit(), assign() and quantisation_error() of a map of rows x cols nodes; rows that lack one of the columns take no part."""

    def __init__(self, rows: int = 6, cols: int = 6, sigma: float = 3.0, last_sigma: float = 0.5, rounds: int = 12):
        self.shape, self.sigmas = (rows, cols), np.geomspace(sigma, last_sigma, rounds)

    def fit(self, df: DataFrame, columns: list[str]) -> BatchMap:
        self.columns = list(columns)
        rows = self._known(df).select(*[F.col(c).cast("double").alias(c) for c in columns])
        x = staged(rows.groupBy(*columns).agg(F.count("*").cast("double").alias("_rows")), "map-rows")  # equal rows have one nearest node
        self._start(x)
        i, j = (v.ravel() for v in np.indices(self.shape))
        apart = (i[:, None] - i) ** 2 + (j[:, None] - j) ** 2
        for sigma in self.sigmas:
            n, s = self._sums(x)
            near = np.exp(-apart / (2 * sigma**2))
            weight = near @ n
            self.nodes = np.where(weight[:, None] > 0, (near @ s) / np.maximum(weight, 1e-300)[:, None], self.nodes)
        return self

    def _known(self, df: DataFrame) -> DataFrame:
        there = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in self.columns]
        return df.where(reduce(lambda a, b: a & b, there))

    def _start(self, x: DataFrame) -> None:
        d = len(self.columns)
        pairs = [(a, b) for a in range(d) for b in range(a, d)]
        c = self.columns
        w = F.col("_rows")
        first = x.agg(F.sum(w).alias("n"), *[(F.sum(w * F.col(v)) / F.sum(w)).alias(f"m{a}") for a, v in enumerate(c)]).first()
        if not first.n:
            raise ValueError("there are no rows to map")
        mean, cov = np.array([first[f"m{a}"] for a in range(d)]), np.zeros((d, d))
        off = [F.col(v) - float(m) for v, m in zip(c, mean, strict=True)]
        r = x.agg(*[(F.sum(w * off[a] * off[b]) / first.n).alias(f"c{a}_{b}") for a, b in pairs]).first()
        for a, b in pairs:
            cov[a, b] = cov[b, a] = r[f"c{a}_{b}"]
        size, axes = np.linalg.eigh(cov)
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(d)] < 0, -1, 1)  # the sign is no one's choice
        reach = np.sqrt(np.maximum(size, 0))
        at = [np.linspace(-1.5, 1.5, k) if k > 1 else np.zeros(1) for k in self.shape]
        down = at[0][:, None, None] * axes[:, -1] * reach[-1]
        across = at[1][None, :, None] * (axes[:, -2] * reach[-2] if d > 1 else np.zeros(d))
        self.nodes = (mean + down + across).reshape(-1, d)

    def _sums(self, x: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        nodes, columns = self.nodes, self.columns

        def run(batches):
            n, s = np.zeros(len(nodes)), np.zeros(nodes.shape)
            for batch in batches:
                v = _matrix(batch, columns)
                best, _ = _nearest(v, nodes)
                w = batch.column("_rows").to_numpy()
                n += np.bincount(best, w, len(nodes))
                for j in range(v.shape[1]):
                    s[:, j] += np.bincount(best, w * v[:, j], len(nodes))
            yield pa.RecordBatch.from_pydict({"cell": pa.array([np.column_stack([n, s]).ravel().tolist()], pa.list_(pa.float64()))})

        parts = x.mapInArrow(run, "cell array<double>").select(F.posexplode("cell").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        out = np.zeros(len(nodes) * (nodes.shape[1] + 1))
        for r in parts.collect():  # the map's size
            out[r.i] = r.v
        out = out.reshape(len(nodes), -1)
        return out[:, 0], out[:, 1:]

    def assign(self, df: DataFrame) -> DataFrame:
        """df's rows that have all columns, with node (row * cols + column of the map; of equally near ones the first) and distance."""
        nodes, columns = self.nodes, self.columns

        def run(batches):
            for batch in batches:
                best, far = _nearest(_matrix(batch, columns), nodes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(far)], [*batch.schema.names, "node", "distance"])

        kept = self._known(df).drop("node", "distance")
        return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("node", T.IntegerType()), T.StructField("distance", T.DoubleType())]))

    def quantisation_error(self, df: DataFrame) -> float:
        return self.assign(df).agg(F.avg("distance")).first()[0]
