import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import regression as G
from tidewake.operators.layers import clusters


def test_local_lines_equal_lowess_on_all_rows(spark):
    rng = np.random.default_rng(4)
    for x in (np.sort(rng.uniform(0, 10, 5000)), np.sort(rng.integers(0, 40, 900) / 4.0), np.array([1.0, 1.5, 2.0])):
        y = np.sin(x) + rng.normal(0, 0.2, len(x))
        want = G.lowess(x, y, 0.3, 0)
        at = sorted({0, len(x) // 3, len(x) // 2, len(x) - 1})
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (2.0, None)], "e double, c double")
        got = {r.place: r.fitted for r in G.local_line(df, "e", "c", [float(x[i]) for i in at]).collect()}
        assert got == pytest.approx({float(x[i]): want[i] for i in at}, abs=1e-9)
    same = spark.createDataFrame([(1.0, float(i)) for i in range(6)], "e double, c double")  # all rows of one place count, not some of them
    assert [(r.place, r.fitted) for r in G.local_line(same, "e", "c", [1.0]).collect()] == [(1.0, 2.5)]
    assert G.local_line(df.limit(0), "e", "c", [1.0]).count() == 0


def test_shapiro_of_known_samples():
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]  # men's weights of the test's first publication
    w, p = G.shapiro(np.array(weights))
    assert w == pytest.approx(0.7888, abs=1e-4) and p == pytest.approx(0.0067, abs=1e-4)
    rng = np.random.default_rng(1)
    assert np.mean([G.shapiro(rng.normal(size=60))[1] < 0.05 for _ in range(400)]) == pytest.approx(0.05, abs=0.035)
    assert G.shapiro(rng.exponential(size=200))[1] < 1e-6 and G.shapiro(rng.normal(size=5000))[0] > 0.998
    for n in (3, 4, 5, 6, 11, 12):
        w, p = G.shapiro(rng.normal(size=n))
        assert 0 < w <= 1 and 0 <= p <= 1
    with pytest.raises(ValueError):
        G.shapiro(np.ones(9))


def test_clusters_merge_upwards(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), int(s)) for a, b, s in zip(rng.uniform(-89, 89, 500), rng.uniform(-180, 180, 500), rng.integers(0, 2, 500), strict=True)] + [(None, 1.0, 1), (1.0, None, 0)]
    df = spark.createDataFrame(rows, "latitude double, longitude double, is_fishing int")
    out = clusters(df, (0, 3, 9))
    by = {r.zoom: r for r in out.groupBy("zoom").agg(F.sum("n_points").alias("n"), F.count("*").alias("k"), F.sum(F.col("share") * F.col("n_points")).alias("ones")).collect()}
    assert {z: r.n for z, r in by.items()} == {0: 500, 3: 500, 9: 500} and by[0].k <= 16 < by[3].k <= by[9].k
    assert all(abs(r.ones - sum(s for *_, s in rows[:500])) < 1e-6 for r in by.values())
    assert clusters(df.limit(0)).count() == 0


def test_no_fishing_points_are_an_error(spark):
    from tidewake.operators.hexgrid import run_hex

    df = spark.createDataFrame([(1, 1, 0, -6.0, 39.0, 1.0, 0)], "trip_id long, event_id long, t_us long, latitude double, longitude double, speed double, is_fishing int")
    with pytest.raises(ValueError, match="no fishing points"):
        run_hex(df, F.timestamp_micros("t_us").cast("timestamp_ntz"))
