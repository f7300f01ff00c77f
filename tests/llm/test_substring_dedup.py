import hashlib
import random

from tidewake.llm import substring_dedup as S


def brute(pairs, k):
    pairs = sorted(pairs, key=lambda x: (x[0] is not None, x[0] or 0))
    first, out = {}, {}
    for i, t in pairs:
        w = (t or "").encode().split()
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), (i, j))
    for i, t in pairs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] != (i, j):
                gone[j : j + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_against_brute_force(docs, clashing, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(S, "BUCKET", 300)
    monkeypatch.setattr(S, "CHUNK", 2000)
    monkeypatch.setattr(S, "BLOCK", 900)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(80):
        w = [rng.choice("abcdé") for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            a = rng.randint(0, 30)
            w[rng.randint(0, len(w)) :] = passage[a : a + rng.randint(5, 30)]
        texts.append(rng.choice([" ", "\t", "\n "]).join(w) if i % 11 else None)
    texts += [texts[3], texts[3], " ".join("ab"), " ".join(["same"] * 500), "x " * 30_000]
    pairs = list(enumerate(texts))
    want = brute(pairs, 5)
    got = {r.doc_id: r for r in S.substring_dedup(clashing(docs(texts)), window=5).collect()}
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and sum(x.end - x.start for x in r.removed) == r.n_removed for r in got.values())


def test_ids_and_empty(docs):
    t = " ".join(f"w{i}" for i in range(25))
    out = S.substring_dedup(docs([(None, t), (4, t), (4, t), (5, "few words")])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in out) == [("4", 25), ("4", 25), ("5", 0), ("None", 0)]
    assert S.substring_dedup(docs(["x"]).limit(0)).count() == 0
    assert [r.n_words for r in S.substring_dedup(docs([None, ""])).collect()] == [0, 0]


def test_null_ids_are_told_apart(docs):
    a, b = (" ".join(f"{x}{i}" for i in range(25)) for x in "ab")
    out = S.substring_dedup(docs([(None, a), (None, b), (None, a + " " + b), (7, b + " end")])).collect()
    none = sorted(r.n_removed for r in out if r.doc_id is None)
    assert sum(none) in (25, 50) and sum(r.n_words - r.n_removed for r in out) == 51  # each passage stays once


def test_confused_windows_remove_nothing_else(docs, monkeypatch):
    monkeypatch.setattr(S, "LEAST_BYTES", 1)
    monkeypatch.setattr(S, "FINGERPRINT_BITS", -200)  # one byte: most windows are taken for others
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(60)) for _ in range(60)]
    texts += [texts[i] for i in range(0, 60, 3)]
    got = S.substring_dedup(docs(texts), window=5).collect()
    want = brute(list(enumerate(texts)), 5)
    for r in got:
        assert r.n_removed in (0, want[r.doc_id][1]) or r.n_removed < want[r.doc_id][1]
    assert all(r.n_removed == 0 for r in got if r.doc_id < 60)


def test_packing():
    import numpy as np

    for x in ([], [0], [5, 5, 3, -7, 2**40, -(2**63), 2**63 - 1]):
        x = np.array(x, np.int64)
        assert S.unpack(S.pack(x), len(x)).tolist() == x.tolist()
