"""Centroid clustering by sort-means: exact k-means on whole-number vectors.

Before a round the other centroids are sorted by their distance from each centroid, on the driver, as they are k by k
numbers.  A vector starts at the centroid of the last round and looks at the others in that order; it stops at the
first one strictly farther from the start than twice the vector's own distance to it, since from there on none can be
as near (at just twice the distance one may still tie, and the smaller number wins).  Vectors are scanned in blocks: in
step r those still looking meet their centroid's r-th neighbour, and whoever stops never comes back.

A round is one pass without an exchange that writes vectors and clusters to the shared folder, and one over that table
that sums up the components by cluster (k sums of each task meet in one aggregate).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import drop_staged
from .common import inline_rows, stored, table

#: Bytes of vectors that a task holds at once, as 64-bit numbers.
BLOCK_BYTES = 4 << 20
VECTORS = "vec_id bigint, v array<bigint>, cluster int, distance bigint"


def whole_vectors(vectors: DataFrame, dim: int, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (floor(scale * x) of each component) of the vectors with dim components, none null or non-finite."""
    v = F.col("e")
    # NaN is greater than all numbers in Spark
    finite = F.forall(v, lambda x: F.coalesce((x < F.lit(float("inf"))) & (x > F.lit(float("-inf"))), F.lit(False)))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("e"))
    return rows.where((F.size("e") == dim) & finite).select("vec_id", F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"))


def nearest(x: np.ndarray, start: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid (ties: the smaller number) and squared distance, from its start on."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    order = np.argsort(apart, axis=1, kind="stable")
    own = ((x - centroids[start]) ** 2).sum(1)
    best, least = start.copy(), own.copy()
    looking = np.arange(len(x))
    for r in range(len(centroids)):
        other = order[start[looking], r]
        # twice the distance: four times its square; whole quotients, as four times a distance may not fit
        near = apart[start[looking], other] // 4 + (apart[start[looking], other] % 4 > 0) <= own[looking]
        looking, other = looking[near], other[near]
        if not len(looking):
            break
        found = ((x[looking] - centroids[other]) ** 2).sum(1)
        better = (found < least[looking]) | ((found == least[looking]) & (other < best[looking]))
        best[looking[better]], least[looking[better]] = other[better], found[better]
    return best, least


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, BLOCK_BYTES // (8 * dim))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    def run(batches):
        c = np.array(centroids, np.int64)
        for part, x in _blocks(batches, c.shape[1]):
            cluster, distance = nearest(x, part.column("cluster").to_numpy().astype(np.int64), c)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "v", "cluster", "distance"])

    return vectors.mapInArrow(run, VECTORS)


def _sums(vectors: DataFrame, k: int, dim: int) -> dict[int, list[int]]:
    """Count and sums of components of each cluster that has vectors; k times dim numbers reach the driver."""

    def run(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for part, x in _blocks(batches, dim):
            cluster = part.column("cluster").to_numpy()
            n += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, x)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(has, pa.int32()), "sums": pa.array([[int(n[c]), *total[c].tolist()] for c in has], pa.list_(pa.int64()))})

    parts = vectors.select("v", "cluster").mapInArrow(run, "cluster int, sums array<bigint>")
    cells = parts.select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out: dict[int, list[int]] = {}
    for r in cells.collect():
        out.setdefault(r.cluster, [0] * (dim + 1))[r.i] = int(r.x)
    return out


def sort_means(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, salt: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v, cluster, distance) of all vectors kept, and the final centroids; see whole_vectors for which are kept and how they are made whole.

    The k kept vectors with the smallest sha256 of `salt:vec_id` are the first centroids (fewer vectors: fewer centroids).
    After each round a centroid becomes the floor of its vectors' mean; one without vectors stays.  Rows don't depend
    on each other: rows equal in id or vector each get their result, null ids come last among the first centroids, ties
    of hashes go by components, equal centroids let the smaller number win, and other columns aren't looked at.  No
    vector kept: no rows and no centroids.  Numbers so large that a squared distance may not fit into 64 bits are an error.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, dim, scale, id_col, vector_col)
    now = stored(kept.select("*", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "sort-means-0")
    top = now.agg(F.max(F.array_max("v")).alias("hi"), F.min(F.array_min("v")).alias("lo")).first()
    if top.hi is None:
        return now, []
    if dim * (top.hi - top.lo) ** 2 >= 2**63:
        raise ValueError(f"components from {top.lo} to {top.hi} (times {scale:g}): squared distances don't fit into 64 bits")
    drawn = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    centroids = [r.v for r in now.orderBy(drawn.asc_nulls_last(), "v").limit(k).select("v").collect()]
    for i in range(rounds + 1):
        before, now = now, stored(_assigned(now, centroids), f"sort-means-{i + 1}")
        drop_staged(before)
        if i < rounds:
            for c, (n, *sums) in _sums(now, len(centroids), dim).items():
                centroids[c] = [s // n for s in sums]
    return now, centroids


def op11_sort_means(spark, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings, with the inertia of each cluster and of all, and a digest of each centroid."""
    told, centroids = sort_means(table(spark, sf_dir, "embeddings"))
    inertia = {r.cluster: int(r.d) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [{"cluster": c, "cluster_inertia": d, "inertia": sum(inertia.values()), "centroid_sha256": digests[c]} for c, d in inertia.items()]
    about = inline_rows(spark, rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return told.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256) -> str:
    parts = [
        "t AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings "
        f"WHERE len(embedding) = {dim} AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0)",
        f"x AS MATERIALIZED (SELECT rid, vec_id, unnest(range({dim})) AS i, floor({scale} * unnest(embedding)::DOUBLE)::BIGINT AS v FROM t)",
        "first AS (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || vec_id), embedding) - 1 AS c FROM t)",
        f"c0 AS MATERIALIZED (SELECT c, i, v FROM x JOIN first USING (rid) WHERE c < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"d{r} AS (SELECT rid, c, sum((x.v - c{r}.v) * (x.v - c{r}.v)) AS d FROM x JOIN c{r} USING (i) GROUP BY rid, c),\n"
            f"a{r} AS MATERIALIZED (SELECT rid, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"
        )
        if r < rounds:
            parts.append(
                f"m{r} AS (SELECT c, i, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM x JOIN a{r} USING (rid) GROUP BY c, i),\n"
                f"c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, v)::BIGINT AS v FROM c{r} LEFT JOIN m{r} USING (c, i))"
            )
    return (
        "WITH " + ",\n".join(parts) + f",\nh AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)\n"
        "SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256\n"
        f"FROM a{rounds} JOIN t USING (rid) JOIN h USING (c)"
    )


SQL = _sql()
