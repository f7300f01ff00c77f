import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm.sort_means import nearest, sort_means

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k, rounds, dim):
    """Lloyd's rounds with Python's whole numbers; rows: (id, vector)."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in map(np.float32, v)]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        told = assign()
        for j in range(len(cents)):
            if own := [v for (_, v), (_, c) in zip(kept, told, strict=True) if c == j]:
                cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, assign(), strict=True)), key=str), cents


def made(n, dim, rng, spread=3):
    return [(i, [rng.randint(-spread, spread) / 16 for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("k", [1, 7, 40])
def test_against_plain_rounds(spark, k):
    rng = random.Random(k)
    rows = made(300, 4, rng) + [(5, [0.0] * 4), (5, [0.0] * 4), (None, [0.5] * 4), (None, [0.5] * 4)] + [(1000 + i, [0.25, -0.25, 0.0, 0.1]) for i in range(150)]
    rows += [(-1, None), (-2, [0.1] * 3), (-3, [0.1, None, 0.1, 0.1]), (-4, [float("nan"), 0.0, 0.0, 0.0]), (-5, [float("inf"), 0.0, 0.0, 0.0]), (-6, [0.0] * 5), (-7, [])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit(3) for c in ("cluster", "v", "distance", "e", "label")})
    got, cents = sort_means(df, k=k, rounds=3, dim=4)
    want, want_cents = plain(rows, k, 3, 4)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=str) == want
    assert cents == want_cents


def test_fewer_vectors_than_centroids_and_none(spark):
    got, cents = sort_means(spark.createDataFrame(made(3, 2, random.Random(1)), SCHEMA), k=9, rounds=2, dim=2)
    assert got.count() == 3 and len(cents) == 3
    got, cents = sort_means(spark.createDataFrame([], SCHEMA), dim=2)
    assert got.count() == 0 and cents == []


def test_too_large_numbers_are_an_error(spark):
    with pytest.raises(ValueError, match="64 bits"):
        sort_means(spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 0.0])], SCHEMA), dim=2)


def test_scan_stops_early_and_keeps_ties():
    rng = np.random.default_rng(2)
    for _ in range(30):
        c = rng.integers(-4, 5, (rng.integers(1, 12), 3))
        x, start = rng.integers(-6, 7, (50, 3)), rng.integers(0, len(c), 50)
        best, least = nearest(x, start, c)
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (least == d.min(1)).all() and (best == d.argmin(1)).all()
