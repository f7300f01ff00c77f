"""Time windows of large trips, which are dealt out by time, against Spark's moving frames."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import rolling as R
from tidewake.operators.kinematics import kinematics
from tidewake.plans import effort


def points(n=600, trips=(None, 1, 2)):
    rng = np.random.default_rng(3)
    rows = [(trips[k % len(trips)], k, int(rng.integers(0, 3600)) * 1_000_000, float(rng.uniform(-6.02, -5.98)), float(rng.uniform(39, 39.04))) for k in range(n)]
    return rows + rows[:40] + [(None, 9000, 7_000_000, None, 39.0), (2, 9001, -90_000_000, -6.0, 39.0)]


SCHEMA = "trip_id long, event_id long, t_us long, latitude double, longitude double"


@pytest.mark.parametrize("minutes", [(10.0,), (5.0, 30.0)])
def test_times_dealt_out_give_the_moving_frames(spark, minutes):
    df = kinematics(spark.createDataFrame(points(), SCHEMA)).withColumn("acceleration", F.when(F.col("event_id") % 3 > 0, F.col("acceleration")))
    df = df.unionByName(df.where("event_id < 9").withColumn("t_us", F.lit(None).cast("long")))
    want = R.time_stats(df, minutes, None)
    for got in (R.time_stats(df, minutes, 0), R.time_stats(df, minutes, 210)):  # all trips, and one of them
        assert "_stretch" in got._jdf.queryExecution().toString()
        assert {f.name: f.dataType for f in got.schema} == {f.name: f.dataType for f in want.schema}
        names = sorted(want.columns)
        key = lambda r: (str(r.trip_id), r.event_id, str(r.t_us), str(r.leg_km))
        a, b = (sorted(d.select(*names).collect(), key=key) for d in (got, want))
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert list(x) == pytest.approx(list(y), abs=1e-9)


def test_frames_keep_digits_and_grow_with_their_rows():
    x = np.append(np.full(1000, 1e6 + 0.1), np.random.default_rng(1).normal(50, 9, 300))
    low, high = np.array([0, 3, 1000, 1100, 7, 990, 1299]), np.array([1000, 4, 1300, 1257, 7, 1010, 1300])
    mean, std, top, least = R.frames(x, low, high)
    assert (std[[0, 1, 4, 6]] == 0).all() and np.isnan([mean[4], top[4], least[4]]).all()
    for k in (0, 1, 2, 3, 5, 6):
        part = x[low[k] : high[k]]
        assert [mean[k], top[k], least[k]] == pytest.approx([part.mean(), part.max(), part.min()], rel=1e-13)
        assert len(part) < 2 or std[k] == pytest.approx(part.std(ddof=1), abs=1e-7)
    n = 400_000
    began = time.process_time()
    R.frames(np.arange(n, dtype=float), np.maximum(np.arange(n) - n // 4, 0), np.minimum(np.arange(n) + n // 4, n))
    assert time.process_time() - began < 20  # 7e10 values, read one by one, take minutes


def test_rules_of_large_trips(spark, monkeypatch):
    df = spark.createDataFrame(points(), SCHEMA)
    want = effort.classify(df, "planar")
    monkeypatch.setattr(R, "large_trips", lambda df, whole=0, f=R.large_trips: f(df, 210))
    got = effort.classify(df, "planar")
    assert "_stretch" in got._jdf.queryExecution().toString()  # by time
    names = ["trip_id", "event_id", "n_near", "speed_cv", "straightness", "radius_gyration_km", "sinuosity", "dist_to_start_km", "fishing_score", "is_fishing", "point_number", "total_points"]
    assert sorted(got.columns) == sorted(want.columns)
    a, b = (sorted(d.select(*names).collect(), key=lambda r: (str(r.trip_id), r.event_id, r.point_number)) for d in (got, want))
    for x, y in zip(a, b, strict=True):
        assert list(x) == pytest.approx(list(y), abs=1e-8)
