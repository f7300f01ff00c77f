import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewake.llm.filter_audit import FILTERS, audit, flags

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def failing(doc_id, text, pairs):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(words) < 100 else set()
    out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
    out |= {"D"} if re.search("[#$%&*|]", text) else set()
    same = [i for i, t in pairs if t == text and i is not None]
    return out | ({"E"} if any(doc_id is None or i < doc_id for i in same) else set())


def plain(docs, labels):
    """Applies each order's filters one after the other."""
    pairs = [(i, t or "") for i, t, _ in docs]
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    out, shapley = {}, {}
    for part in {x or "" for _, _, x in docs}:
        own = [(i, failing(i, t or "", pairs)) for i, t, x in docs if (x or "") == part]
        for order in map("".join, itertools.permutations(FILTERS)):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                now = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                row = [len(left), len(now), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in own), sum(r[0] in good and r[0] is not None for r in now), sum(r[0] in toxic and r[0] is not None for r in now)]
                out[part, order, step] = row
                gone += now
                shapley[part, f] = shapley.get((part, f), 0) + len(now)
    return {k: (*row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def made(rng):
    words = ["a", "the", "Sea", "NET", "boat", "fish#", "x|y", "tide", "50%", "é"] + [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words[: rng.choice([4, 10, 210])]) for _ in range(rng.choice([0, 3, 99, 100, 101, 130]))) for _ in range(40)]
    texts += [None, "", " \t\n\x0b", "ABC", "word " * 20_000, "a b" * 5 + " c", "café A"]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, "", "fr"])) for i in range(300)]
    return rows + [(7, "same text", "en"), (7, "same text", "en"), (None, "same text", "en"), (None, None, None), (None, "alone", "en"), (900, "tide " * 150, "en")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_each_order(spark, clashing, seed):
    rng = random.Random(seed)
    rows = made(rng)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 280)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (99_999, 1, 1)]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(4)).withColumns({c: F.lit(1) for c in ("failed", "good", "part", "C", "first_id", "step", "quality")})
    got = audit(flags(docs, spark.createDataFrame(labels, LABELS)))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got.collect()} == plain(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert audit(flags(spark.createDataFrame([], DOCS), none)).count() == 0
    got = audit(flags(spark.createDataFrame([(1, "a b", "en")], DOCS), none))
    assert got.count() == 600 and got.where("toxic_lost + good_lost > 0").count() == 0


def test_words_need_no_exchange_of_their_own(spark):
    from tidewake.llm.filter_audit import word_counts

    plan = word_counts(spark.range(10).select(F.col("id").alias("rid"), F.lit("a b").alias("text")).repartition("rid"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
