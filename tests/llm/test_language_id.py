import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import language_id as L

EN = "the cat and the dog went to the house with this other thing"
DE = "der hund und die katze gehen nicht zum haus mit dieser sache"


def corpus(docs, n=60):
    a, b = EN.split(), DE.split()
    texts = [" ".join((a if i % 2 else b)[j % 12] for j in range(i, i + 5 + i % 4)) for i in range(n)]
    return docs(texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))


def test_learns_from_its_fold_and_predicts(docs, clashing):
    d = clashing(corpus(docs))
    model = L.learned(d)
    out = L.identify(d.select("doc_id", "text", "lang"), model).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and np.mean([r.lang == r.lang_pred for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in out)
    assert d.where(L.held_out(d["doc_id"])).count() == len(held)
    assert (model.weights != 0).mean() < 0.05  # sparse


def test_edges(docs):
    model = L.learned(corpus(docs))
    texts = [None, "", "12 ++ 3", "a", EN + " " + "x" * 200_000, "\x00", "the\x00the"]
    out = {r.doc_id: r for r in L.identify(docs(texts).select("doc_id", "text"), model).collect()}
    assert [out[i].lang_pred for i in (0, 1, 2, 5)] == ["und"] * 4 and out[0].score == 0
    assert out[3].lang_pred in ("de", "en") and out[4].lang_pred == "en" and out[6].lang_pred == "en"
    none = docs(["x y"]).withColumn("lang", F.lit(None).cast("string"))
    assert L.learned(none) is None and L.identify(none.select("text"), None).first().lang_pred == "und"
    assert L.learned(docs(["a"]).limit(0)) is None


def test_grams_and_temperature():
    cells, n = L.grams(["ab", "", "abc", "x"])
    assert n.tolist() == [1, 0, 3, 0] and cells[0] == cells[1]
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 4000)
    s = rng.normal(0, 1, (4000, 3)) + 2 * np.eye(3)[y]
    true = L.temperature(s * 2.0, y)
    assert abs(L.temperature(s * 8.0, y) / true - 4) < 0.05


def test_clashing_columns_are_replaced_and_repeated_rows_agree(docs, clashing):
    d = corpus(docs)
    model = L.learned(d)
    twice = clashing(d.unionByName(d))
    out = L.identify(twice, model)
    assert sorted(out.columns) == sorted([*twice.columns]) and out.where("lang_pred = '7'").count() == 0
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score, r.known))
    assert all(len(v) == 1 for v in by.values())
    assert L.identify(twice, None).where("lang_pred = 'und' and score = 0").count() == twice.count()


def test_scores_don_t_depend_on_what_is_gathered_at_a_time(docs, monkeypatch):
    d = corpus(docs)
    model = L.learned(d)
    one = [(r.doc_id, r.lang_pred, round(r.score, 9)) for r in L.identify(d, model).collect()]
    monkeypatch.setattr(L, "GATHERED", 14)  # seven n-grams of two labels
    assert one == [(r.doc_id, r.lang_pred, round(r.score, 9)) for r in L.identify(d, model).collect()]


def test_equal_scores_give_the_first_label(docs):
    model = L.learned(corpus(docs))
    assert {r.lang_pred for r in L.identify(docs(["x", "x", "q"]), model).collect()} == {"de"}


def plain_cells(text):
    """2- and 3-grams in order of their places, hashed with plain whole numbers."""
    m, out = 2**32 - 1, []
    c = [ord(x) for x in text.lower().replace("\x00", " ")]

    def cell(x):
        x ^= x >> 16
        x = x * 0x7FEB352D & m
        return (x ^ x >> 15) & (L.DIM - 1)

    two = [(a * 0x9E3779B1 + b * 0x85EBCA77) & m for a, b in zip(c, c[1:], strict=False)]
    for i, t in enumerate(two):
        out.append(cell(t))
        if i + 2 < len(c):
            out.append(cell((((t ^ t >> 15) * 0x2C1B3C6D & m) + c[i + 2] * 0x297A2D39) & m))
    return out


def plain_scores(rows, texts):
    """FTRL with one weight after the other; rows: (text, lang) for training and calibration in order of their draw."""
    labels = sorted({x for _, x in rows})
    n_docs, seen = len(rows), Counter(c for t, _ in rows for c in set(plain_cells(t)))
    idf = lambda c: math.log((n_docs + 1) / (seen.get(c, 0) + 1)) + 1
    held = {x: sum(y == x for _, y in rows) * L.PER_LANGUAGE_CALIBRATION // (L.PER_LANGUAGE + L.PER_LANGUAGE_CALIBRATION) for x in labels}
    own, fit, rest = Counter(), [], []
    for t, x in rows:
        own[x] += 1
        (fit if own[x] > held[x] else rest).append((t, labels.index(x)))
    z, n = {}, {}

    def weight(key):
        if abs(z.get(key, 0.0)) <= L.L1:
            return 0.0
        return -(z[key] - math.copysign(L.L1, z[key])) / ((L.BETA + math.sqrt(n[key])) / L.ALPHA + L.L2)

    def score(text):
        cells = Counter(plain_cells(text))
        total = max(1, sum(cells.values()))
        x = {c: L.SCALE * k / total * idf(c) for c, k in cells.items()}
        return x, [sum(v * weight((c, j)) for c, v in x.items()) for j in range(len(labels))]

    def chances(s):
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    rng = np.random.default_rng(7)
    for _ in range(L.EPOCHS):
        for i in rng.permutation(len(fit)):
            x, s = score(fit[i][0])
            for j, p in enumerate(chances(s)):
                for c, v in x.items():
                    g, old, w = v * (p - (j == fit[i][1])), n.get((c, j), 0.0), weight((c, j))
                    z[c, j] = z.get((c, j), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / L.ALPHA * w
                    n[c, j] = old + g * g
    temp = L.temperature(np.array([score(t)[1] for t, _ in rest]), np.array([y for _, y in rest]))
    out = []
    for t in texts:
        p = chances([v / temp for v in score(t)[1]])
        out.append((labels[p.index(max(p))], max(p)))
    return out


def test_predictions_against_a_plain_loop(docs):
    d = corpus(docs, 80)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = [(r.text, r.lang) for r in d.where(~L.held_out(F.col("doc_id"))).select("text", "lang", draw.alias("s")).orderBy("s", "text").collect()]
    told = L.identify(d.select("doc_id", "text"), L.learned(d)).orderBy("doc_id").collect()
    for r, (lang, score) in zip(told, plain_scores(rows, [r.text for r in told]), strict=True):
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_held_out_accuracy(spark):
    out = L.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.99 * held.count() > 200


def test_fences_go_by_label(docs):
    rng = np.random.default_rng(5)
    en, el = EN.split(), "και το είναι σε που με για την από δεν θα στη τα μας".split()
    texts = [" ".join(rng.choice(en, 25)) for _ in range(400)] + [" ".join(rng.choice(el, 40)) for _ in range(6)] + [" ".join(rng.choice(list("шщъыэюя"), 90))]
    d = docs(texts).withColumn("lang", F.when(F.col("doc_id") < 400, "en").when(F.col("doc_id") < 406, "el").otherwise("one"))
    model = L.train(d)
    least = dict(zip(model.labels, model.least, strict=True))
    assert least["en"] > 0.4 > least["one"] == least["el"] == 0.0
    out = L.identify(d.select("doc_id", "text"), model).where(L.surely(F.col("text"), model))
    assert out.count() == 407  # rare labels keep all their texts
    junk = L.identify(docs(["日本語漢字世界国民人口山川" * 8, "бвгд жзкл " * 10]).select("text"), model)
    assert junk.where(L.surely(F.col("text"), model) & (F.col("lang_pred") == "en")).count() == 0
