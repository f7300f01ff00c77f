import random

from pyspark.sql import functions as F

from tidewake.operators import hexgrid as H

POINTS = "trip_id long, event_id long, t_us long, latitude double, longitude double, speed double, is_fishing int"


def made(spark, n=600):
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(12)]), i, rng.choice([None, *[rng.randrange(0, 400 * 86_400) * 1_000_000 for _ in range(4)]]), -6 + 0.02 * rng.randrange(3), 39.0, rng.choice([None, 1.0, 2.5]), 1) for i in range(n)]
    df = spark.createDataFrame(rows, POINTS)
    return H.fishing_points(df, F.timestamp_micros("t_us").cast("timestamp_ntz"))


def test_slices_count_distinct_things_exactly(spark):
    points = made(spark)
    got = {(r.slice, r.cell, r.year, r.month, r.season, r.day_night): (r.n_points, r.n_trips, r.n_days, r.vessel_days, round(r.fishing_hours, 6)) for r in H.metrics(points, 7).collect()}
    want = {}
    for name, keys in H.SLICES.items():
        rows = H.with_cell(points, 7).groupBy("cell", *keys).agg(F.count("time").alias("n"), F.count_distinct("trip_id").alias("t"), F.count_distinct("date").alias("d"), F.count_distinct(F.struct("trip_id", "date")).alias("v"), F.round(F.sum("time_hours"), 6).alias("h"))
        for r in rows.collect():
            key = tuple(r[k] if k in keys else None for k in H._KEYS)
            want[(name, r.cell, *key)] = (r.n, r.t, r.d, r.v, r.h)
    assert got == want


def test_no_expand_and_no_window_over_slices(spark):
    plan = H.trip_cube(made(spark), 7)
    by = plan.groupBy("cell", "trip_id").agg(F.array_sort(F.collect_list(F.struct(*H._KEYS, "days", "undated", "time_hours", "n", "first", "last", "v0", "v1", "v2"))).alias("e"))
    text = by.select(F.explode(H._entries(H.SLICES)))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text and text.count("Exchange hashpartitioning") == 1


def test_exact_roll_up_counts_once(spark):
    fine = H.trip_cube(made(spark), 7)
    for only in ({}, {"day_night": "day"}, {"year": 1970}):
        points = H.with_cell(made(spark), 7).where("date is not null")
        kept = fine.where("year is not null")
        for k, v in only.items():
            points = points.where(F.col(k) == v)
        want = {r.cell: (r.t, r.d, r.v) for r in points.groupBy("cell").agg(F.count_distinct("trip_id").alias("t"), F.count_distinct("date").alias("d"), F.count_distinct(F.struct("trip_id", "date")).alias("v")).collect()}
        assert {r.h: (r.nt, r.nd, r.vd) for r in H.roll_up_exact(kept, **only).collect()} == want


def test_empty(spark):
    assert H.metrics(made(spark).limit(0), 7).count() == 0 and H.quality(H.metrics(made(spark).limit(0), 7)).count() == 0
