import random

import numpy as np
import pytest

from tidewake.operators.quantiles import average_ranks, quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("small", [0, 10**6])
@pytest.mark.parametrize("kind", ["spread", "ties", "few", "one"])
def test_quantiles_are_exact(spark, kind, small):
    rng = random.Random(kind)
    make = {"spread": lambda: [rng.gauss(0, 1) for _ in range(12000)], "ties": lambda: [float(rng.choice([1, 1, 1, 2, 7, rng.randint(0, 500)])) for _ in range(12000)], "few": lambda: [3.0, -1.0, 2.0], "one": lambda: [5.0]}[kind]
    groups = {"a": make(), "b": make()}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v] + [("a", None), ("none", None)], "g string, x double")
    got = {r.g: r.q for r in quantiles(df, "x", PROBS, ["g"], small_rows=small).collect()}
    assert got.keys() == groups.keys()
    for g, v in groups.items():
        assert got[g] == pytest.approx(np.quantile(v, PROBS).tolist(), abs=1e-12)
    assert quantiles(df, "x", PROBS, small_rows=small).first().q == pytest.approx(np.quantile(groups["a"] + groups["b"], PROBS).tolist(), abs=1e-12)
    assert quantiles(df.where("x is null"), "x", PROBS, small_rows=small).count() == 0


@pytest.mark.parametrize("small", [0, 10**6])
def test_average_ranks(spark, small):
    rng = random.Random(1)
    rows = [(i % 3, float(rng.choice([1, 2, rng.randint(0, 4000)]))) for i in range(6000)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = sorted((r.g, r.x, r.k) for r in average_ranks(df, "x", "k", ["g"], small_rows=small).collect())
    want = []
    for g in range(3):
        v = sorted(x for h, x in rows if h == g)
        first = {}
        for i, x in enumerate(v):
            first.setdefault(x, []).append(i + 1)
        want += [(g, x, sum(first[x]) / len(first[x])) for x in v]
    assert got == sorted(want)
    alone = sorted((r.x, r.k) for r in average_ranks(df, "x", "k", small_rows=small).collect())
    assert alone[0][1] >= 1 and sum(k for _, k in alone) == pytest.approx(6000 * 6001 / 2)


@pytest.mark.parametrize("kind", ["spread", "ties", "skewed"])
def test_brackets_narrow_in_rounds(spark, kind):
    rng = random.Random(kind)
    make = {"spread": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.choice([1, 1, 1, 1, 2, rng.randint(0, 50)])), "skewed": lambda: rng.paretovariate(0.3)}[kind]
    groups = {"a": [make() for _ in range(30000)], "b": [make() for _ in range(50)]}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "g string, x double")
    got = {r.g: r.q for r in quantiles(df, "x", PROBS, ["g"], small_rows=0, few=100).collect()}
    for g, v in groups.items():
        assert got[g] == pytest.approx(np.quantile(v, PROBS).tolist(), rel=1e-12)


def test_ranks_by_ranges(spark):
    rng = random.Random(3)
    rows = [(i % 2, float(rng.choice([5, rng.randint(0, 900)]))) for i in range(4000)]
    df = spark.createDataFrame(rows, "g int, x double")
    a, b = (sorted(map(tuple, average_ranks(df, "x", "k", by, small_rows=small, few=100).select("g", "x", "k").collect())) for by in (["g"],) for small in (0, 10**6))
    assert a == b
    a, b = (sorted(map(tuple, average_ranks(df, "x", "k", small_rows=small, few=100).select("g", "x", "k").collect())) for small in (0, 10**6))
    assert a == b
