"""Exact duplicates through an extendible-hash index on shared files.

A first pass counts rows and bytes per prefix of the texts' 64-bit hash.  From those counts (at most
2**MAX_DEPTH of them) the driver builds the directory as an extendible hash does: a bucket over its capacity
is split on its next hash bit, doubling the directory where its depth is reached.  Neighbouring buckets form
key ranges of about one capacity, each with an owner task.  A bucket that is still too large at the last depth
(one text, copied many times) is spread over overflow pages.  The second pass sends each row to its owner once;
there rows of one hash are chained by their bytes: equal hashes with other bytes are other chain links.  The
index (bucket, page, hash, chain link, row) is written to the shared folder.  Pages of one bucket are merged by
comparing one text of each chain link and page.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import inline_rows, stored

MAX_DEPTH = 16


def build_directory(counts: dict[int, tuple[int, int]], capacity: int, max_depth: int = MAX_DEPTH) -> list[dict]:
    """The directory's buckets in key order.

    counts: prefix of max_depth bits -> (rows, bytes).  A bucket has its prefix, depth, owner (key ranges of at
    most about one capacity) and pages (more than 1 only where the last depth is reached and it is still too full).
    """
    items = sorted((p, b) for p, (_, b) in counts.items())
    buckets: list[dict] = []

    def split(prefix: int, depth: int, lo: int, hi: int) -> None:
        size = sum(b for _, b in items[lo:hi])
        if size > capacity and depth < max_depth:
            edge = ((prefix << 1) + 1) << (max_depth - depth - 1)
            mid = next((i for i in range(lo, hi) if items[i][0] >= edge), hi)
            split(prefix << 1, depth + 1, lo, mid)
            split((prefix << 1) + 1, depth + 1, mid, hi)
        else:
            buckets.append({"prefix": prefix, "depth": depth, "size": size, "pages": max(1, math.ceil(size / capacity))})

    split(0, 0, 0, len(items))
    unit, room = 0, 0
    for b in buckets:
        if room and (room + b["size"] > capacity or b["pages"] > 1):
            unit, room = unit + 1, 0
        b["unit"] = unit
        room += b["size"]
        if b["pages"] > 1:
            unit, room = unit + b["pages"], 0
    return buckets


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 32 << 20, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, bucket_depth, chain.

    A null text counts as empty.  Of equal texts the row with the largest id stays; null ids are the smallest; of
    rows equal in id and text one stays.  Other columns of docs are not looked at.  An empty table gives no rows.
    capacity: bytes of text that a bucket, and so an owner task, holds; of large inputs it holds twice a 2**max_depth-th,
    so that buckets of ordinary texts are never paged and owners stay fewer than 2**max_depth, and its task sorts on disk.
    Pages are dealt by id: copies of one text in which very many rows also have one id (or none) share a page.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    size = F.octet_length("text") + 16
    slot = F.shiftrightunsigned("h", 64 - max_depth)
    found = rows.groupBy(slot.alias("p")).agg(F.count("*").alias("n"), F.sum(size).alias("b")).collect()  # at most 2**max_depth
    capacity = max(capacity, 2 * sum(r.b for r in found) >> max_depth)
    buckets = build_directory({r.p: (r.n, r.b) for r in found}, capacity, max_depth)
    depth = max(b["depth"] for b in buckets)
    entries = [{"slot": s, "bucket": i, "depth": b["depth"], "unit0": b["unit"], "pages": b["pages"]} for i, b in enumerate(buckets) for s in range(b["prefix"] << (depth - b["depth"]), (b["prefix"] + 1) << (depth - b["depth"]))]
    directory = inline_rows(spark, entries, "slot bigint, bucket int, depth int, unit0 int, pages int")
    units = max(b["unit"] + b["pages"] for b in buckets)

    at = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    routed = rows.withColumn("slot", at).join(F.broadcast(directory), "slot", "left")  # 2**depth entries, max_depth at most
    routed = routed.withColumn("unit", F.col("unit0") + F.pmod(F.xxhash64("doc_id"), F.col("pages")).cast("int")).drop("slot", "unit0")
    same = W.partitionBy("unit", "bucket", "h", "text")
    index = (
        routed.repartition(units, "unit")
        .withColumn("chain", F.dense_rank().over(W.partitionBy("unit", "bucket", "h").orderBy("text")))
        .withColumn("rn", F.row_number().over(same.orderBy(F.col("doc_id").desc_nulls_last())))
        .withColumn("keep_id", F.max("doc_id").over(same))
        .withColumn("n", F.count("*").over(same))
        .select("bucket", "depth", "unit", "pages", "h", "chain", "doc_id", "rn", "keep_id", "n", F.sha2("text", 256).alias("sha"), F.when((F.col("pages") > 1) & (F.col("rn") == 1), F.col("text")).alias("chain_text"))
    )
    index = stored(index, "exthash")

    def shown(df: DataFrame, keep, n, kept) -> DataFrame:
        return df.select("doc_id", keep.alias("keep_id"), n.cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), "bucket", F.col("depth").alias("bucket_depth"), "chain")

    out = shown(index.where("pages = 1"), F.col("keep_id"), F.col("n"), F.col("rn") == 1)
    if any(b["pages"] > 1 for b in buckets):
        over = W.partitionBy("h", "chain_text")
        links = index.where("pages > 1 and rn = 1").select(
            "unit", "h", "chain", F.max("keep_id").over(over).alias("all_keep"), F.sum("n").over(over).alias("all_n"), (F.row_number().over(over.orderBy(F.col("keep_id").desc_nulls_last(), "unit")) == 1).alias("first_page")
        )
        paged = index.where("pages > 1").join(links, ["unit", "h", "chain"])
        out = out.unionByName(shown(paged, F.col("all_keep"), F.col("all_n"), (F.col("rn") == 1) & F.col("first_page")))
    return out


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
