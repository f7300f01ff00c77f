"""Sharding by a hierarchical weighted hash tree.

At each level (region, rack, shard) every child of the node reached so far draws -ln(u)/weight from a hash of the
row's key and the child's name; the least draw wins.  A child's share is its weight over its siblings' weights, and
changing one child's weight moves rows only into or out of that child: all other children keep their draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import draw52, inline_rows, table

#: A tree is {name: weight} at the lowest level and {name: subtree} above; a node weighs what its leaves weigh.
Tree = dict


def tree_of(shards: int, racks: int = 2, per_rack: int = 2, base: int = 8) -> Tree:
    """The tree for a shard count: the first `base` shards lie in regions of `racks` racks of `per_rack` shards of weight 1; each further shard is a region of its own, so that adding it changes no existing subtree.

    A count below `base` is an error: its tree would lose parts of subtrees, and one more shard would move rows between the others."""
    if shards < base:
        raise ValueError(f"the tree has {base} shards at least, not {shards}")
    tree: Tree = {}
    for s in range(shards):
        if s < base:
            region, rack = s // (racks * per_rack), s // per_rack
            tree.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[f"shard{s}"] = 1
        else:
            tree[f"region-{s}"] = {f"rack-{s}": {f"shard{s}": 1}}
    return tree


def weight(node) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else node


def descend(key: Column, tree: Tree, seed: str = "shard") -> Column:
    """The name of the leaf that the key reaches.  Children of weight 0 get nothing; of equal draws the first name wins."""
    best = [F.struct((-F.log((draw52(seed, name, key) + 1).cast("double") / F.lit(2.0**52 + 1)) / F.lit(float(weight(child)))).alias("draw"), F.lit(name).alias("name")) for name, child in tree.items() if weight(child) > 0]
    won = (F.array_min(F.array(*best)) if len(best) > 1 else best[0]).getField("name")
    if not any(isinstance(c, dict) for c in tree.values()):
        return won
    down = [(name, descend(key, child, seed)) for name, child in tree.items() if weight(child) > 0]
    out = F.when(won == down[0][0], down[0][1])
    for name, leaf in down[1:]:
        out = out.when(won == name, leaf)
    return out


def shard(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", runs: int = 512) -> DataFrame:
    """All columns of docs, then size (UTF-8 bytes of the text, null: none, plus 1), text_crc32, law, shard, slot, grown_shard.

    Columns of docs with those names are replaced.  slot numbers a shard's rows from 0 without gaps: rows are ordered by
    a hash of the id in `runs` runs per shard; each run is numbered in a task of its own, after the runs before it.  Rows
    of one id (null ids too) lie in one shard.  An empty table gives no rows.
    """
    key = docs[id_col]
    mine = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    number = lambda leaf: F.regexp_extract(leaf, r"(\d+)$", 1).cast("int")
    text = F.coalesce(docs[text_col], F.lit(""))
    row = F.struct(*[docs[c] for c in docs.columns if c not in mine]).alias("row")
    placed = docs.select(row, key.alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), number(descend(key, tree)).alias("shard"), (number(descend(key, grown)) if grown else F.lit(None).cast("int")).alias("grown_shard"), draw52("slot", key).alias("spot"))
    placed = placed.withColumn("run", F.expr(f"cast(spot div {2**52 // runs + 1} as int)"))
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = counts.select("shard", "run", (F.sum("n").over(W.partitionBy("shard").orderBy("run")) - F.col("n")).alias("before"))
    order = W.partitionBy("shard", "run").orderBy("spot", F.col("key").asc_nulls_first(), "text_crc32", "size")
    out = placed.withColumn("nth", F.row_number().over(order) - 1).join(F.broadcast(before), ["shard", "run"])  # shards * runs rows
    return out.select("row.*", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"), "grown_shard")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, tree_of(8), tree_of(9)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _leaf_sql(tree: Tree, seed: str = "shard") -> str:
    """descend() of doc_id as SQL."""
    spot = lambda name: f"('0x' || substr(md5('{seed}|{name}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT"
    draws = [f"{{'draw': -ln(({spot(name)} + 1)::DOUBLE / {2**52 + 1}::DOUBLE) / {float(weight(child))}::DOUBLE, 'name': '{name}'}}" for name, child in tree.items() if weight(child) > 0]
    won = f"list_sort([{', '.join(draws)}])[1]['name']"
    if not any(isinstance(c, dict) for c in tree.values()):
        return won
    return f"CASE {won} {' '.join(f"WHEN '{name}' THEN {_leaf_sql(child, seed)}" for name, child in tree.items() if weight(child) > 0)} END"


def _crc_table() -> list[int]:
    """The remainders of CRC-32 (polynomial 0xEDB88320, reflected) for each byte."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _sql() -> str:
    leaf = lambda shards: f"regexp_extract({_leaf_sql(tree_of(shards))}, '[0-9]+$')::INT"
    return f"""
WITH hexed AS (SELECT doc_id, coalesce(text, '') AS t, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
bytes AS (SELECT doc_id, octet_length(encode(t)) + 1 AS size, list_transform(range(1, octet_length(encode(t)) + 1), lambda i: (strpos('0123456789ABCDEF', h[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i]) - 1) AS b FROM hexed),
crc AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda c, x: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes),
placed AS (SELECT *, {leaf(8)} AS shard, {leaf(9)} AS grown_shard, md5('slot|' || coalesce(doc_id::VARCHAR, 'null'))[1:13] AS spot FROM crc)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY spot, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM placed
"""


SQL = _sql()
