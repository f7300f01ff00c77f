"""Steps that only large tables show, on small ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import ml as M
from tidewake.operators.nearby import Track
from tidewake.operators.quantiles import quantiles
from tidewake.operators.regression import correlation_p
from tidewake.operators.rolling import near_shape
from tidewake.plans import catch_queries as CQ


def test_p_values_in_sql_hold_for_any_number_of_pairs():
    duckdb = pytest.importorskip("duckdb")
    cases = [(-0.586027, 5882070), (0.00033, 36_000_000), (0.9, 216_000_000), (0.0001, 216_000_000), (0.05, 2001), (0.05, 1999), (0.3, 50), (-0.97, 3), (0.6, 4), (0.0, 10)]
    rows = ", ".join(f"({r}::DOUBLE, {n}::BIGINT)" for r, n in cases)
    got = duckdb.connect().sql(f"WITH rr AS (SELECT * FROM (VALUES {rows}) v(r, n)), {CQ._TEST} SELECT r, n, p, {CQ._STARS} FROM pp").fetchall()
    assert len(got) == len(cases)
    for r, n, p, marks in got:
        want = correlation_p(r, n)
        assert p == pytest.approx(want, abs=2e-6) and (marks == "***") == (want < 0.001)


@pytest.mark.parametrize("planar", [True, False])
def test_large_trips_are_dealt_out_by_tiles(spark, planar):
    rng = np.random.default_rng(5)
    rows = [(None if k % 3 else 1, k, int(rng.integers(0, 500)) * 1000, float(rng.uniform(-6.02, -5.98)), float(rng.uniform(39, 39.04)), k) for k in range(900)]
    rows += [(1, k, k * 1000, -6.0, 179.999 + 0.001 * (k % 3) - 360 * (k % 3 > 1), k) for k in range(300)]
    rows += rows[:60] + [(1, 5000, 7, None, 39.0, 1), (None, 5001, 7, -6.0, float("nan"), 1), (2, 1, 0, -6.0, 39.0, 3), (2, 2, 1, -6.0, 39.001, 3)]
    df = spark.createDataFrame(rows, "trip_id long, event_id long, t_us long, latitude double, longitude double, sinuosity int")
    want = near_shape(df, 1.0, planar)
    got = near_shape(df, 1.0, planar, whole=100, pairs=5_000)
    assert "_t0" in got._jdf.queryExecution().toString()  # by tiles
    assert got.schema == want.schema
    key = lambda r: (str(r.trip_id), r.event_id, r.t_us)
    a, b = (sorted(d.collect(), key=key) for d in (got, want))
    assert len(a) == len(b) == len(rows)
    for x, y in zip(a, b, strict=True):
        assert key(x) == key(y) and x.n_near == y.n_near
        assert [x.straightness, x.radius_gyration_km, x.sinuosity] == pytest.approx([y.straightness, y.radius_gyration_km, y.sinuosity], abs=1e-8)


def test_points_one_by_one_give_the_matrices_sums():
    rng = np.random.default_rng(6)
    lat, lon, w = rng.uniform(0, 0.03, 700), rng.uniform(0, 0.03, 700), rng.integers(1, 3, 700)
    for planar in (True, False):
        track = Track(lat, lon, w, 1.0, planar, lat.mean())
        want = track.shapes()
        told = {}
        track._by_points(np.arange(0, 700, 7), lambda i, t: told.update({i: t}))
        assert [told[i][0] for i in told] == want[0][::7].tolist()
        assert [np.sqrt(t[2] / t[0]) for t in told.values()] == pytest.approx(want[2][::7].tolist(), abs=1e-8)
        some = track.shapes(np.arange(3, 700, 5))
        assert all(a == pytest.approx(b[3::5], abs=1e-12) for a, b in zip(some, want, strict=True))


def test_quantiles_read_a_column_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.range(30_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 30_011).cast("double").alias("x")).mapInArrow(counted, "g long, x double")
    probabilities = [k / 10 for k in range(11)]
    got = {r.g: r.q for r in quantiles(df, "x", probabilities, ["g"], small_rows=0, few=1_000).collect()}
    assert read.value == 30_000  # not once a round
    for g in range(3):
        assert got[g] == pytest.approx(np.quantile([i * 7919 % 30_011 for i in range(30_000) if i % 3 == g], probabilities).tolist())


def test_values_meet_the_places_of_their_range_only(spark):
    df = spark.range(30_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 30_011).cast("double").alias("x"))
    probabilities = [(k + 0.5) / 100 for k in range(100)]
    for by in ([], ["g"]):
        out = quantiles(df, "x", probabilities, by, small_rows=0, few=1_000)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Generate explode" in line and "_upto" in line]  # no list of all places at each value
        got = {r.g if by else 0: r.q for r in out.collect()}
        for g in range(2 if by else 1):
            assert got[g] == pytest.approx(np.quantile([i * 7919 % 30_011 for i in range(30_000) if not by or i % 2 == g], probabilities).tolist())


def test_a_forest_reads_its_points_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    schema = "trip_id long, event_id long, t_us long, latitude double, longitude double, Activity string"
    rows = [(k % 7, k, k * 60_000_000, -6 + 0.001 * (k * 37 % 11), 39 + 0.001 * (k * 53 % 13), "Fishing" if k * 37 % 11 > 5 else None) for k in range(300)]
    points = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    forest = M.EffortForest(trees=3, depth=4).fit(points)
    assert read.value == 300  # neither once for each pass nor twice
    features = M.EffortForest.features(points)
    assert sorted(forest.predict(features).select("event_id", "effort_prob").collect()) == sorted(forest.predict(points).select("event_id", "effort_prob").collect())
    assert {r.event_id: r.effort_pred for r in M.EffortForest(trees=3, depth=4).fit(features).predict(features).collect()}.keys() == set(range(300))
