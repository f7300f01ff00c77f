import os
import random

import pytest

from tidewake.llm.token_count import DEFAULT_MODEL, Counter, count_tokens, vocabulary


def tokenizer(pieces):
    from tokenizers import Tokenizer, models, normalizers

    t = Tokenizer(models.Unigram([("<unk>", 0.0), *[(f"<0x{i:02X}>", 0.0) for i in range(256)], *pieces], 0, True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


@pytest.mark.parametrize("crossing", [False, True])
def test_small_vocabularies_with_ties(crossing):
    rng = random.Random(4)
    for _ in range(30):
        pieces = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 4)) for _ in range(14)}
        if not crossing:
            pieces = {p: s for p, s in pieces.items() if "▁" not in p.lstrip("▁")}
        exact, mine = tokenizer(list(pieces.items())), Counter(list(pieces.items()))
        for _ in range(60):
            text = "".join(rng.choice("aab  ▁cé🎉\n") for _ in range(rng.randint(0, 14)))
            assert mine.pieces(text) == exact(text), (pieces, text)


@pytest.mark.skipif(not os.path.exists(DEFAULT_MODEL), reason="no vocabulary file")
def test_public_vocabulary_on_rows(docs, clashing):
    pieces = vocabulary(DEFAULT_MODEL)
    exact = tokenizer(pieces)
    texts = ["Hello world  foo", "日本語テキスト🎉x", "a\nb\tc", "", None, "       deep   space ", "x" * 5000, "word " * 20_000]
    out = {r.doc_id: r.n_tokens for r in count_tokens(clashing(docs(texts)), pieces).collect()}
    assert out == {i: exact(t or "") for i, t in enumerate(texts)}
    assert count_tokens(docs(["x"]).limit(0), pieces).count() == 0
    assert [r.n_tokens for r in count_tokens(docs([(None, "a b"), (None, "a b")]), pieces).collect()] == [exact("a b")] * 2


def test_memory_stays_bounded(monkeypatch):
    from tidewake.llm import token_count

    monkeypatch.setattr(token_count, "REMEMBERED", 10)
    c = Counter([("▁a", -1.0), ("b", -1.0)])
    assert c.pieces(" ".join(f"a{'b' * i}" for i in range(60))) == 60 + sum(range(60))
    assert len(c) <= 10
