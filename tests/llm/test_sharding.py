import zlib
from collections import Counter

from tidewake.llm.sharding import shard, tree_of


def test_law_slots_and_digests(docs, clashing):
    texts = [f"text {i % 7} é" for i in range(400)] + [None, ""]
    out = shard(clashing(docs(texts)), tree_of(8), tree_of(9), runs=8).collect()
    assert len(out) == 402
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t) + 1, zlib.crc32(t), "key")
        assert r["grown_shard"] in (r["shard"], 8)  # a further shard takes rows only into itself
    assert set(by) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) < 2 * min(map(len, by.values()))


def test_ties_nulls_and_empty(docs):
    out = shard(docs([(None, "a"), (None, None), (5, "x"), (5, "x"), (5, "y")]), tree_of(8)).collect()
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    assert len({r["shard"] for r in out if r["doc_id"] == 5}) == 1
    assert all(r["grown_shard"] is None for r in out)
    assert shard(docs([("x",)][:0]), tree_of(8)).count() == 0


def test_weights_confine_movement(docs):
    base = {"a": {"r": {"s0": 1, "s1": 1}}, "b": {"r2": {"s2": 1, "s3": 1}}}
    more = {"a": {"r": {"s0": 1, "s1": 3}}, "b": {"r2": {"s2": 1, "s3": 1}}}
    d = docs(["t"] * 600)
    one = {r["doc_id"]: r["shard"] for r in shard(d, base).collect()}
    two = {r["doc_id"]: r["shard"] for r in shard(d, more).collect()}
    moved = Counter((one[i], two[i]) for i in one if one[i] != two[i])
    assert moved and all(to in (0, 1) and frm != 1 for frm, to in moved)  # only into the heavier region, none out of the heavier shard


def test_many_runs_long_texts_and_small_counts(docs):
    long = "word " * 200_000
    out = shard(docs([long, *map(str, range(200))]), tree_of(8), runs=5000).collect()
    assert {r["size"] for r in out if r["doc_id"] == 0} == {1_000_001}
    for s in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    import pytest

    with pytest.raises(ValueError):
        tree_of(7)
    assert len(tree_of(4, base=4)) == 1
