"""Statistics over landings against plain Python and NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import catch as C
from tidewake.operators import regression as G

SCHEMA = "bmu string, gear string, landing_date date, total_fishers double, total_catch_kg double, effort double, cpue double"


@pytest.fixture(scope="module")
def data():
    import datetime as dt

    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        u, g, y = int(rng.integers(0, 6)), ["nets", "traps", "lines"][int(rng.integers(0, 3))], int(rng.integers(2000, 2006))
        e = float(rng.lognormal(0, 0.5))
        c = float(np.exp(-0.3 * np.log(e) + 0.2 * u - 0.05 * (y - 2000) + rng.normal(0, 0.4)))
        rows.append((f" BMU{u} ", g.upper(), dt.date(y, int(rng.integers(1, 13)), 5), float(rng.integers(1, 9)), c * 3, e, c))
    return rows


@pytest.fixture(scope="module")
def landings(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_imputation_cases(spark):
    rows = [("a", "g", None, 4.0, 1.0, 2.0, 1.0), ("a", "g", None, 9.0, 1.0, 3.0, 1.0), ("a", "g", None, 5.0, 1.0, None, 1.0), ("a", "g", None, None, 1.0, None, 1.0), ("b", "g", None, 5.0, 1.0, None, 1.0), ("c", "g", None, 5.0, 1.0, 0.0, 1.0), ("c", "g", None, 5.0, 1.0, None, 1.0)]
    out = [(r.bmu, r.effort, r.effort_imputed) for r in C.impute_effort(C.clean(spark.createDataFrame(rows, SCHEMA))).orderBy("bmu", F.col("total_fishers").asc_nulls_last(), "effort").collect()]
    assert ("a", 5 / 2.5, True) in out and ("a", None, False) in out and ("b", None, False) in out
    assert ("c", 0.0, False) in out and ("c", 0.0, True) in out  # an infinite area leaves no effort


def test_cleaning(spark, landings):
    r = C.clean(landings).first()
    assert r.bmu == r.bmu.strip().lower() and r.gear == r.gear.lower() and 0 <= r.dow <= 6
    text = spark.createDataFrame([(" A ", "x", None, "4", "bad", "1.5", None)], SCHEMA.replace("double", "string"))
    r = C.clean(text).first()
    assert (r.total_fishers, r.total_catch_kg, r.effort, r.season) == (4.0, None, 1.5, "NE Monsoon (JF)")


def test_rank_correlation_with_ties(spark):
    xs, ys = [1, 2, 2, 3, 3, 3, 4, 9], [2, 1, 2, 2, 5, 5, 7, 7]

    def rank(v):
        return [sum(a < b for a in v) + (sum(a == b for a in v) + 1) / 2 for b in v]

    r = C.spearman(spark.createDataFrame([(float(a), float(b)) for a, b in zip(xs, ys, strict=True)], "effort double, cpue double")).first()
    assert r.rho == pytest.approx(np.corrcoef(rank(xs), rank(ys))[0, 1]) and r.n == 8


def test_bins_merge_equal_edges(spark):
    e = [1.0] * 50 + [2.0] * 3 + [float(i) for i in range(3, 40)]
    df = spark.createDataFrame([(x, 2 * x) for x in e], "effort double, cpue double")
    out = {r.bin: r for r in C.quantile_bins(df, 10).collect()}
    edges = sorted({float(np.quantile(e, k / 10)) for k in range(11)})
    want = {}
    for x in e:
        b = 1 if x == edges[0] else sum(v < x for v in edges)
        want.setdefault(b, []).append(x)
    assert {b: r.n for b, r in out.items()} == {b: len(v) for b, v in want.items()}
    assert out[1].effort_median == 1.0


@pytest.mark.parametrize("spec", ["M1", "M2", "M3", "M4", "M5"])
def test_fixed_effects_against_dense_least_squares(landings, spec):
    df = C.working_set(landings).withColumn("log_effort", F.log("effort")).withColumn("log_cpue", F.log("cpue"))
    rows = df.select("bmu", "year", "season", "gear", "effort", "log_effort", "log_cpue").toPandas()
    names, squared = G.SPECS[spec]
    cols, labels = [np.ones(len(rows)), rows.log_effort.to_numpy()], ["const", "log_effort"]
    if squared:
        cols.append(rows.effort.to_numpy() ** 2)
        labels.append("effort_sq")
    for c in names:
        levels = sorted(rows[c].unique())
        first = G.REFERENCES.get(c) if G.REFERENCES.get(c) in levels else levels[0]
        for v in levels:
            if v != first:
                cols.append((rows[c] == v).to_numpy(float))
                labels.append(f"{c}={v}")
    x, y = np.stack(cols, 1), rows.log_cpue.to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    inv, u = np.linalg.inv(x.T @ x), y - x @ beta
    if spec == "M1":
        h = np.einsum("ij,jk,ik->i", x, inv, x)
        meat = (x * (u / (1 - h))[:, None] ** 2).T @ x
    else:
        g = [x[rows.bmu == b].T @ u[rows.bmu == b] for b in rows.bmu.unique()]
        meat = sum(np.outer(s, s) for s in g) * len(g) / (len(g) - 1) * (len(y) - 1) / (len(y) - x.shape[1])
    se = math.sqrt((inv @ meat @ inv)[1, 1])
    got = G.fit(df, spec)
    assert got["beta"] == pytest.approx(beta[1], rel=1e-6) and got["se"] == pytest.approx(se, rel=1e-5)
    assert got["r2"] == pytest.approx(1 - (u @ u) / ((y - y.mean()) @ (y - y.mean())), rel=1e-6) and got["n"] == len(y)
    assert got["coefficients"] == pytest.approx(dict(zip(labels, beta, strict=True)), rel=1e-5, abs=1e-7)


def test_two_way_demeaning_of_balanced_data(spark):
    rows = [(f"u{u}", 2000 + y, 0.1 * u + 0.2 * y - 0.3 * ((u * y) % 5), float((u * y) % 5)) for u in range(4) for y in range(5)]
    r = C.within_fit(spark.createDataFrame(rows, "bmu string, year int, log_cpue double, log_effort double")).first()
    assert r.beta == pytest.approx(-0.3) and r.within_r2 == pytest.approx(1)


def test_numerics():
    assert G.t_sf(2.0, 10) == pytest.approx(0.07338803, rel=1e-6) and G.t_sf(0.5, 3) == pytest.approx(0.65145, rel=1e-4)
    assert G.normal_sf(1.959963984540054) == pytest.approx(0.05)
    x = np.linspace(0, 1, 60)
    assert np.allclose(G.lowess(x, 3 * x + 1), 3 * x + 1)
    pct, loadings, scores = G.pca(np.array([[1.0, 2], [2, 4], [3, 6.5], [4, 8]]))
    assert pct.sum() == pytest.approx(100) and pct[0] > 99 and loadings.shape == (2, 2) and scores.shape == (4, 2)
    data = np.concatenate([np.zeros((30, 2)), np.ones((30, 2)) * 5])
    som = G.SelfOrganisingMap(4, 4).fit(data, 2000)
    assert som.quantisation_error(data) < 0.7 and som.winner(data[0]) != som.winner(data[-1])
    assert C.elasticity(-0.1, -0.2, 0.0)[1]["beta"] == pytest.approx(0.7**-0.1 - 1)
    assert np.allclose(G.polyfit([(0, 1, 4), (1, 3, 9), (2, 5, 1)], 1), [2, 1])


def test_effects_and_response(landings):
    df = C.working_set(landings).withColumn("log_effort", F.log("effort")).withColumn("log_cpue", F.log("cpue"))
    a, b = G.fit(df, "M2"), G.fit(df, "M4")
    assert len(G.fixed_effects(a, "bmu")) == 5 and G.effects_correlation(a, b) > 0.9
    assert G.response(-0.5, 1.0, 2.0, [1.0, 4.0]) == [(1.0, 2.0), (4.0, 1.0)]
    assert a["low"] < a["beta"] < a["high"] and a["p"] < 0.05


def test_landings_without_a_date_take_no_part(spark, landings):
    df = C.working_set(landings).withColumn("log_effort", F.log("effort")).withColumn("log_cpue", F.log("cpue"))
    odd = df.limit(3).withColumn("year", F.lit(None).cast("int")).withColumn("season", F.lit(None).cast("string"))
    for spec in ("M1", "M4"):
        a, b = G.fit(df, spec), G.fit(df.unionByName(odd), spec)
        assert a["n"] == b["n"] and a["beta"] == pytest.approx(b["beta"]) and a["se"] == pytest.approx(b["se"])


def test_residuals_gears_and_p_values(spark, landings):
    df = C.working_set(landings).withColumn("log_effort", F.log("effort")).withColumn("log_cpue", F.log("cpue"))
    fit = G.fit(df, "M5")
    r = G.residuals(df, fit).agg(F.avg("residual").alias("m"), F.sum(F.pow("residual", 2)).alias("ss"), F.corr("residual", "log_effort").alias("c"), F.var_pop("log_cpue").alias("v"), F.count("*").alias("n")).first()
    assert abs(r.m) < 1e-9 and abs(r.c) < 1e-6 and 1 - r.ss / (r.v * r.n) == pytest.approx(fit["r2"], rel=1e-6)
    pairs = G.quantile_pairs(G.residuals(df, fit), "residual", 20).collect()
    assert len(pairs) == 20 and pairs[0].theoretical == pytest.approx(-1.959964, rel=1e-5)
    assert C.gear_subset(df, ["NETS"]).select("gear").distinct().collect()[0][0] == "nets"
    with pytest.raises(ValueError, match="harpoon"):
        C.gear_subset(df, ["harpoon"])
    out = C.with_p(spark.createDataFrame([(0.5, 12), (0.1, 2), (None, 9)], "r double, n long"), "r", "n").collect()
    assert [x.p is None for x in out] == [False, True, True] and out[0].p == pytest.approx(0.0979, abs=1e-3)
    some = G.sampled(spark.range(1000), 100, ["id"])
    assert 50 < some.count() < 160 and some.count() == G.sampled(spark.range(1000), 100, ["id"]).count() and G.sampled(spark.range(5), 9, ["id"]).count() == 5
