"""Filter interaction audit: what each of five filters removes alone, together and in every order.

A relational pipeline: texts are dealt out by row once; words are exploded there and summed up by (row, word), then by
row, for totals and distinct words.  The flags that need no words (capitals, signs, copies) are worked out beside it
and outer-joined, as texts without words have no row there; labels are outer-joined by id.  One aggregate by part and
label then has a conditional count for each of the 32 sets of filters that a row may fail.  All orders of filters
follow from those counts alone.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import drop_staged
from .common import WORD, stored, table

FILTERS = "ABCDE"
SETS = 2 ** len(FILTERS)
#: Least words, least percent of words that differ, most percent of capitals, signs.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 100, 80, 10, "[#$%&*|]"
_SPACES = r"[\x20\x09-\x0D]+"
_REST = ("good", "toxic")


def word_counts(texts: DataFrame) -> DataFrame:
    """rid, n_words and n_distinct of the texts (rid, text) that have words; they must be dealt out by rid for a plan without a further exchange."""
    words = texts.select("rid", F.explode(F.split("text", _SPACES)).alias("word")).where("word <> ''")
    return words.groupBy("rid", "word").agg(F.count("*").alias("n")).groupBy("rid").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, part, good, toxic (booleans) and failed (bits of the filters that it fails, A the lowest).

    A null text is an empty one, a null part the part ''.  A row is a copy (E) if a smaller id has the same text; a null
    id counts as larger than all others, so repeated rows of one id aren't copies of each other.  A label is good or
    toxic for an id if any of its rows in labels says so; ids without one, and null ids, are neither.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    rows = stored(
        texts.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", "part", "text", F.unhex(F.sha2("text", 256)).alias("digest"),
            (100 * capitals > CAPITAL_PERCENT * F.length("text")).alias("C"), F.col("text").rlike(SIGNS).alias("D"),
        ),
        "filter-audit",
    )
    words = word_counts(rows.select("rid", "text").repartition("rid"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # a row is no copy if it is its text's first: joined by text and id, so that the copies of one text aren't dealt to one task
    firsts = firsts.select(F.col("digest").alias("first_digest"), "first_id", F.lit(True).alias("is_first"))
    others = rows.select("rid", "doc_id", "part", "digest", "C", "D").join(firsts, (F.col("digest") == F.col("first_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    found = others.drop("digest", "first_digest", "first_id").join(marks, "doc_id", "left").join(words, "rid", "left")
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    copy = F.col("is_first").isNull()
    fails = {"A": n < MIN_WORDS, "B": 100 * distinct < DISTINCT_PERCENT * n, "C": F.col("C"), "D": F.col("D"), "E": copy}
    failed = sum((F.when(fails[f], 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    out = found.select("doc_id", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), failed.alias("failed"))
    out._staged_rows = rows
    return out


def _orders() -> list[dict]:
    """Each order's steps: its filter's bit, the bits of the filters before, and those up to the step."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        name, seen = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            out.append({"filter_order": name, "step": step, "bit": 1 << f, "seen": seen})
            seen |= 1 << f
    return out


def audit(flagged: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    flagged: rows of flags().  No rows: no parts.  The only exchanges are of sums by part.
    """
    sets = [F.count_if(F.col("failed") == s).alias(f"s{s}") for s in range(SETS)]
    counts = flagged.groupBy("part", *_REST).agg(*sets)
    total = lambda s, only=None: F.sum(F.when(F.col(only), F.col(f"s{s}")).otherwise(0) if only else F.col(f"s{s}"))
    by_part = counts.groupBy("part").agg(*[F.array(*[total(s, only) for s in range(SETS)]).alias(name) for name, only in (("all", None), ("good", "good"), ("toxic", "toxic"))])
    steps = F.from_json(F.lit(json.dumps(_orders())), "array<struct<filter_order:string,step:int,bit:int,seen:int>>")
    at = by_part.select("*", F.explode(steps).alias("at")).select("part", "all", *_REST, "at.*")

    def summed(counts: str, where) -> Column:
        return F.aggregate(F.transform(F.col(counts), lambda n, s: F.when(where(s), n).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b)

    bit, seen = F.col("bit"), F.col("seen")
    fails, before = (lambda s: s.bitwiseAND(bit) != 0), (lambda s: s.bitwiseAND(seen) != 0)
    told = at.select(
        "part", "filter_order", "step", "bit",
        summed("all", lambda s: ~fails(s) & ~before(s)).alias("kept"),
        *[summed(c, lambda s: fails(s) & ~before(s)).alias(n) for c, n in (("all", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))],
        summed("all", lambda s: fails(s) & before(s)).alias("redundant"),
        summed("all", lambda s: s == bit).alias("unique_fails"),
    )
    shares = told.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return told.join(shares, ["part", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents; their sums by part are written, so that the texts' table can go."""
    flagged = flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    out = stored(audit(flagged), "filter-audit-sums")
    drop_staged(flagged._staged_rows)
    return out


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, part, t, regexp_extract_all(t, '{WORD}') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (len(ws) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws))::INT
        + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {CAPITAL_PERCENT} * length(t))::INT
        + 8 * (regexp_matches(t, '{SIGNS}'))::INT + 16 * (CASE WHEN w.doc_id IS NULL THEN first_id IS NOT NULL ELSE first_id < w.doc_id END)::INT AS s
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, s, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, s),
p(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p1.l || p2.l || p3.l || p4.l || p5.l AS filter_order, [p1.b, p2.b, p3.b, p4.b, p5.b] AS bs FROM p p1, p p2, p p3, p p4, p p5 WHERE p1.b | p2.b | p3.b | p4.b | p5.b = 31),
t AS (SELECT filter_order, k::INT AS step, bs[k] AS b, coalesce(list_sum(bs[1:k - 1]), 0)::INT AS seen FROM (SELECT *, unnest(range(1, 6)) AS k FROM o)),
r AS (SELECT part, filter_order, step, b,
        coalesce(sum(n) FILTER (s & (seen | b) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (s & b > 0 AND s & seen = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (s & b > 0 AND s & seen > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (s = b), 0)::BIGINT AS unique_fails,
        coalesce(sum(g) FILTER (s & b > 0 AND s & seen = 0), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (s & b > 0 AND s & seen = 0), 0)::BIGINT AS toxic_lost
      FROM c CROSS JOIN t GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley FROM r
"""
