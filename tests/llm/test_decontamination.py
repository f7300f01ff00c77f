import numpy as np
from pyspark.sql import functions as F

from tidewake.llm.decontamination import MIN_WORDS, align, find_copies

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def slow(item, words):
    h, best = [[0] * (len(words) + 1)], 0
    for w in item:
        row = [0]
        for j, v in enumerate(words):
            row.append(max(0, h[-1][j] + (2 if v == w else -1), h[-1][j + 1] - 1, row[-1] - 1))
        best = max(best, *row)
        h.append(row)
    return best


def test_alignment_against_plain_table():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 20))
        assert align(a, b)[0] == slow(a.tolist(), b.tolist())


def test_copies_edits_and_clean_documents(spark, docs, clashing):
    w = ITEM.split()
    edited = " ".join(x for i, x in enumerate(w) if i % 7 != 3)
    texts = ["before " * 50 + ITEM.upper() + "! after" * 30, "x, " + edited + " y", " ".join(w[:6]), "nothing of it " * 40, None, "", ITEM + " z" * 100_000, " ".join(w[:12]) + " other words here"]
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (None, ITEM), (10, "completely other words that nobody ever wrote down anywhere else at all")], "item_id long, text string")
    out = {r.doc_id: r.found for r in find_copies(clashing(docs(texts)), bench).collect()}
    assert [i for i in out if out[i]] == [0, 1, 6, 7]
    assert out[0][0].item_id == 7 and out[0][0].score == 1.0 and (out[0][0].start, out[0][0].end) == (50, 70)
    assert 0.6 < out[1][0].score < 1 and 0.5 <= out[7][0].score < 0.7
    assert len(w) > MIN_WORDS
    assert find_copies(docs(["a"]), bench.limit(0)).first().found == []
    assert find_copies(docs(["a"]).limit(0), bench).count() == 0


def test_many_copies_and_blocks(spark, docs, monkeypatch):
    from tidewake.llm import decontamination

    monkeypatch.setattr(decontamination, "ITEM_BYTES", 100)  # several blocks of items
    other = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, ITEM), (2, other), (3, ITEM)], "item_id long, text string")
    out = find_copies(docs([ITEM + " and " + other] + [ITEM] * 100), bench).collect()
    assert [sorted(x.item_id for x in r.found) for r in out] == [[1, 2, 3]] + [[1, 3]] * 100  # frequent n-grams stay seeds


def test_copies_in_more_documents_than_the_limit(spark, docs):
    w = [f"w{i}" for i in range(40)]
    edited = " ".join(f"edit{i}" if i % 5 == 4 else x for i, x in enumerate(w))  # unbroken: 8 of 37 n-grams
    bench = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(f"v{i}" for i in range(20)))], "item_id long, text string")
    out = find_copies(docs([f"a b {edited} c"] * 40 + ["x y", " ".join(w[:4]) + " other words"]), bench).collect()
    assert [[x.item_id for x in r.found] for r in out] == [[1]] * 40 + [[], []]
    assert out[0].found[0].score == 0.7125 and (out[0].found[0].start, out[0].found[0].end) == (2, 41)
    part = spark.createDataFrame([(1, " ".join(w[:32]))], "item_id long, text string")
    out = find_copies(docs([" ".join(w[:32])] * 40 + ["q " + " ".join(w[15:32]) + " q"]), part).collect()
    assert [len(r.found) for r in out] == [1] * 41  # the second half alone, all n-grams equally frequent


def random_text(rng, n):
    """Words of unequal frequency, as in prose."""
    return [f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, n), 3000)]


def changed(rng, words, part):
    """A copy with that part of its words replaced, dropped or followed by another."""
    out = []
    for w in words:
        kind = rng.integers(0, 3) if rng.random() < part else None
        out += {None: [w], 0: [f"x{rng.integers(10**6)}"], 1: [], 2: [w, f"x{rng.integers(10**6)}"]}[kind]
    return out


def test_recall_against_full_alignment(spark, docs):
    rng = np.random.default_rng(11)
    items = [random_text(rng, int(rng.integers(8, 40))) for _ in range(40)]
    texts = [random_text(rng, 80) for _ in range(80)]
    for k, item in enumerate(items):
        for part in (0.1, 0.2, 0.3):
            texts.append(random_text(rng, 30) + changed(rng, item, part) + random_text(rng, 30))
            if k % 4 == 0:
                texts[-1] = texts[-1] * 2  # twice in one text
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {r.doc_id: {x.item_id: x.score for x in r.found} for r in find_copies(docs([" ".join(t) for t in texts]), bench).collect()}
    code = {w: i for i, w in enumerate(sorted({w for t in texts + items for w in t}))}
    number = lambda t: np.array([code[w] for w in t])
    truth = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            score = align(number(item), number(t))[0] / (2 * len(item))
            if score >= 0.5:
                truth[d, i] = score
    got = {(d, i): s for d, x in found.items() for i, s in x.items()}
    assert set(got) <= set(truth) and len(truth) > 100
    planted = {(80 + 3 * k + j, k) for k in range(40) for j in range(3)} & set(truth)
    assert len(planted) > 100 and len(planted & set(got)) >= 0.98 * len(planted)
    assert len([k for k in truth if got.get(k) == truth[k]]) >= 0.93 * len(truth)  # chance matches of short items too, and the best score


def test_short_items_word_for_word(spark, docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, "yes no"), (3, "only"), (4, "big red dog")], "item_id long, text string")
    texts = ["so One, two three four five six seven!", "one two three four five six", "yes no", "Yes, no.", "say yes no", "only", "the big red dog", "big dog red", ""]
    out = find_copies(docs(texts), bench).collect()
    assert [[x.item_id for x in r.found] for r in out] == [[1], [], [2], [2], [], [3], [4], [], []]
    again = find_copies(docs([texts[0], texts[0]]), bench.unionByName(bench)).collect()
    assert [[x.item_id for x in r.found] for r in again] == [[1], [1]]


def test_counts_of_n_grams_stay_in_spark(spark, docs, monkeypatch):
    """Only n-grams over the limit reach the driver, whatever the items' number."""
    import pyarrow as pa

    from tidewake.llm import decontamination as D

    seen = []
    dropped = D.Items.drop_frequent
    monkeypatch.setattr(D.Items, "drop_frequent", lambda self, k: (seen.append((len(k), self.number)), dropped(self, k)))
    monkeypatch.setattr(D, "RARE_AT_LEAST", 5)
    items = [(i, " ".join(f"w{(i * 7 + j) % 9000}x{i % 13}" for j in range(6)) + " of the sea") for i in range(20_000)]
    bench = spark.createDataFrame(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}).to_pandas())
    texts = [f"before {items[i][1]} after" for i in range(0, 40)] + ["ships of the sea"] * 10
    out = D.find_copies(docs(texts), bench).select("doc_id", F.col("found.item_id").alias("ids")).collect()
    assert all(r.doc_id in r.ids for r in out if r.doc_id < 40) and not any(r.ids for r in out if r.doc_id >= 40)
    assert seen and all(k <= 3 < number for k, number in seen)  # "of the" and "the sea"
