from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from tidewake.llm.mixing import budgets, mix, production


def fill(total, nodes):
    """Exact water filling by repeated rounds: name -> (supply, weight)."""
    out, left = {}, dict(nodes)
    while left:
        w = sum(v[1] for v in left.values())
        short = [k for k, v in left.items() if v[0] * w <= total * v[1]]
        if not short:
            return out | {k: int(Fraction(total) * v[1] / w) for k, v in left.items()}
        for k in short:
            out[k] = left.pop(k)[0]
        total -= sum(out[k] for k in short)
    return out


def test_budgets_stay_among_siblings(spark):
    rows = [("d0", "en", "a", 1000), ("d0", "en", "b", 10), ("d0", "fr", "c", 50), ("d1", "en", "a", 5), ("d1", "de", "z", 0), ("d2", "es", "q", 400)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    weights = {"lang": F.when(F.col("lang") == "en", 4).otherwise(1)}
    for fraction, epochs in ((0.5, 1), (0.9, 2), (2.0, 3), (5.0, 1)):
        got = {(r.domain, r.lang, r.source): r.budget for r in budgets(leaves, fraction, weights, epochs).collect()}
        up = defaultdict(int)
        for d, l, s, t in rows:
            for k in ((d,), (d, l), (d, l, s)):
                up[k] += t * epochs
        top = fill(int(sum(r[3] for r in rows) * fraction), {d: (up[(d,)], 1) for d in {r[0] for r in rows}})
        want = {}
        for d, b in top.items():
            for l, c in fill(b, {l: (up[(d, l)], 4 if l == "en" else 1) for x, l, _, _ in rows if x == d}).items():
                want |= {(d, l, s): n for s, n in fill(c, {s: (up[(d, l, s)], 1) for x, y, s, _ in rows if (x, y) == (d, l)}).items()}
        assert got == want


def test_prefixes_epochs_and_edges(docs, clashing):
    texts = [("a " * (1 + i % 5)) for i in range(60)] + [None, "", "  "]
    d = clashing(docs(texts))
    out = production(d, 2, 0.8).collect()
    budget = out[0]["leaf_budget"]
    chosen = sorted((r["cum_before"], r["tokens"]) for r in out if r["cum_before"] is not None)
    run = 0
    for before, tokens in chosen:
        assert before == run < budget or tokens == 0
        run += tokens
    assert sum(r["tokens"] for r in out) >= budget > sum(r["tokens"] for r in out) - 5
    assert out[0]["row"]["slot"] == 7
    twice = production(docs([f"w{i}" for i in range(5)]), 3, 2.5).collect()
    assert sorted(sum(1 for r in twice if r["row"]["doc_id"] == i) for i in range(5)) == [2, 2, 2, 3, 3]
    assert production(docs(["x"]).limit(0), 2, 0.9).count() == 0
    nulls = docs([(None, "a b"), (None, "a b")]).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    assert {r["lang"] for r in mix(nulls, F.lit("d"), {}, 1.0, 1).collect()} == {"(none)"}


def test_many_runs_and_long_texts_change_nothing(docs):
    d = docs(["x " * (i % 7) for i in range(300)] + ["y " * 200_000])
    want = None
    for run_rows in (1, 10, 10**6):
        rows = sorted((r["row"]["doc_id"], r["epoch"], r["cum_before"] or 0) for r in mix(d, F.lit("d"), {}, 0.8, 2, run_rows=run_rows).collect())
        want = want or rows
        assert rows == want
