import random
from itertools import combinations

import numpy as np
import pytest

from tidewake.llm import jaccard_join as J
from tidewake.llm.components import components


def brute(pairs):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in pairs:
        w = (t or "").encode().translate(low).split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(n=150, seed=1):
    rng = random.Random(seed)
    bases = [[f"{b}w{rng.randint(0, 400)}" for _ in range(rng.randint(8, 120))] for b in range(12)]
    line = ["a", "very", "common", "line", "of", "words", "in", "all", "texts", "here"]
    texts = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 9)}"
        texts.append(" ".join((line if i % 2 else []) + w + (line if i % 3 else [])))
    return texts + ["", None, "one", "ONE", "two words", " ".join(line), " ".join(line), "Two  Words", "x " * 20_000]


@pytest.mark.parametrize("block_tokens", [1_500_000, 400])
def test_against_brute_force(docs, clashing, monkeypatch, block_tokens):
    monkeypatch.setattr(J, "BUCKET", 2000)
    monkeypatch.setattr(J, "CHUNK", 4000)
    monkeypatch.setattr(J, "BLOCK", 6000)
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(clashing(docs(texts)), block_tokens=block_tokens).collect()}
    assert got == brute(list(enumerate(texts)))


def test_one_of_each(docs, clashing):
    texts = ["a b c d e f g", "a b c d e f g", "A b c d e f g", "other words", None, ""]
    out = J.one_of_each(clashing(docs([*enumerate(texts), (1, texts[1]), (9, texts[3]), (9, texts[3]), (None, None)])))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "th" in out.columns
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == [("0", texts[0]), ("3", texts[3]), ("4", ""), ("5", ""), ("None", "")]


def test_empty_null_ids(docs):
    assert J.jaccard_join(docs(["x"]).limit(0)).count() == 0
    out = {(r.doc_id, r.component_id) for r in J.jaccard_join(docs([(None, "a b"), (3, "a b"), (None, "c d")])).collect()}
    assert out == {(None, 3), (3, 3), (None, None)}


def test_tree_against_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sets = [np.unique(rng.integers(0, 25, rng.integers(1, 20))).astype(np.uint64) for _ in range(rng.integers(2, 25))]
        sizes = np.array([len(s) + int(rng.integers(0, 3)) for s in sets])
        root = list(range(len(sets)))
        for a, b in combinations(range(len(sets)), 2):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 75 * (sizes[a] + sizes[b] - n):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
        assert J.block_links(sets, sizes, 75) == root


def test_sets_left_out_when_the_largest_component_changes():
    begins = [40, 30, 50, 10, 20, 0, 1, 70, 60, 80, 79, 78]  # windows of 70: linked up to 10 apart, so all in one chain
    sets = [np.arange(b, b + 70).astype(np.uint64) for b in begins]
    assert J.block_links(sets, np.full(12, 70), 75) == [0] * 12
    rng = np.random.default_rng(5)
    for _ in range(200):
        begins = rng.integers(0, 150, 20)
        sets = [np.arange(b, b + 70).astype(np.uint64) for b in begins]
        near = np.sort(begins)
        part = np.concatenate([[0], np.cumsum(np.diff(near) > 10)])
        of = part[np.searchsorted(near, begins)]
        assert J.block_links(sets, np.full(20, 70), 75) == [int(np.flatnonzero(of == x)[0]) for x in of]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 21), (20, 22), (20, 23), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in (2, 3, 4, 5)} | {8: 7, 9: 7} | {i: 20 for i in (21, 22, 23)} | {i: 100 for i in range(101, 141)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_of_shared_passages_without_links_stay_linear(spark, monkeypatch):
    """Sets of 8 passages of 40 shingles each, out of a pool: all in one component of candidates, none linked."""
    import pyarrow as pa

    def sent(percent):
        return lambda t: pa.table({"a": pa.array([sum(len(g) // 8 for g in t.column("grams").to_pylist())], pa.int64()), "b": pa.array([0], pa.int64())})

    real, cost = J._verify, {}
    for n in (200, 800):
        rng = random.Random(3)
        rows = []
        for key in range(n):
            grams = sorted(p * 40 + i for p in rng.sample(range(n // 2), 8) for i in range(40))
            rows.append((key, 320, np.array(grams, np.uint64).tobytes(), grams[: J.prefix_size(320, 75)]))
        reps = spark.createDataFrame(rows, "key long, n long, grams binary, prefix array<long>")
        monkeypatch.setattr(J, "_verify", sent)
        cost[n] = J._links(reps, 75, 8000).agg({"a": "sum"}).first()[0] / (320 * n)
        monkeypatch.setattr(J, "_verify", real)
        assert J._links(reps, 75, 8000).count() == 0
    assert cost[800] < 1.3 * cost[200] < 6


def test_a_frequent_shingle_of_few_long_texts_is_found():
    import pyarrow as pa

    texts = [" ".join(f"t{i}w{j}" for j in range(3000)) + (" a b c d e" if i % 20 == 0 else "") for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    out = [dict(zip(b.column("g").to_pylist(), b.column("n").to_pylist(), strict=True)) for b in J._frequent(5)(iter([batch]))]
    want = int(J.sets_of(J.Words(pa.array(["a b c d e"])), 5)[0].view(np.int64)[0])
    assert sum(x.get(want, 0) for x in out) == 10
