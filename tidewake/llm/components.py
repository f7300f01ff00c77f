"""Connected components by alternating large and small stars (Kiveris and others, 2014), as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import drop_staged
from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node's greater neighbours move to its least neighbour; small: each node and its lesser ones do.

    The least neighbour of a node is an aggregate that is joined back, so that a node with very many edges is split."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    joined = edges.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long) -> node, root for every node of an edge that isn't its component's least node.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest chain."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    sign = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = sign(now)
    while before[0]:
        last, now = now, stored(_star(_star(now, True), False), "components")
        after = sign(now)
        drop_staged(last)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
