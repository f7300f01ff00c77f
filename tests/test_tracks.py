"""Edge cases of track operators against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewake.functions import geo, temporal
from tidewake.operators import kinematics as K
from tidewake.operators import rolling as R
from tidewake.operators import shore as S
from tidewake.operators.columns import ColumnResolver, as_points
from tidewake.operators.phases import phases
from tidewake.operators.rules import CONFIGS, Rules
from tidewake.operators.smoothing import smooth
from tidewake.plans.effort import EffortClassifier, classify

SCHEMA = "trip_id long, event_id long, t_us long, latitude double, longitude double"


def hav(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def trip(spark, points):
    """points: (seconds, lat, lon)"""
    return spark.createDataFrame([(1, i, int(t * 1e6), float(a), float(b)) for i, (t, a, b) in enumerate(points)], SCHEMA)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("trip_id", "t_us", "event_id").collect()]


def test_one_and_two_point_trips(spark):
    one = rows(K.kinematics(trip(spark, [(0, -6, 39)])), "leg_km", "speed_kmh", "acceleration", "jerk", "turn_angle")
    assert one == [(None, 0.0, 0.0, 0.0, 0.0)]
    two = rows(classify(trip(spark, [(0, -6, 39), (60, -6.001, 39)])), "speed_kmh", "straightness", "is_fishing")
    assert two[1][0] == pytest.approx(hav(-6, 39, -6.001, 39) * 60) and two[0][1] == 1.0
    p = rows(phases(trip(spark, [(0, -6, 39), (60, -7, 39)])), "dist_to_start_km", "trip_progress", "trip_phase")
    assert p == [(0.0, 0.0, "in_progress")] * 2


def test_equal_times(spark):
    got = rows(K.kinematics(trip(spark, [(0, -6, 39), (60, -6.01, 39), (60, -6.02, 39), (60, -6.02, 39), (120, -6.03, 39)]), K.PLAIN), "speed_kmh", "acceleration")
    assert got[2] == (0.0, -30.0)  # a change in no time is as large as it gets
    assert got[3] == (0.0, 0.0)  # no change in no time is none
    assert got[4][0] > 0


def test_turn_gate_and_wrap(spark):
    def leg(km):
        return km / 111.19492664455873

    for km, open_ in ((0.0999, False), (0.1001, True)):
        path = [(0, 0, 0), (60, leg(1), 0), (120, leg(1), leg(km)), (180, leg(2), leg(km))]
        turn = rows(K.kinematics(trip(spark, path), K.GATED), "turn_angle")
        assert (turn[2][0] > 80) == open_
    df = spark.createDataFrame([(350.0, 10.0), (10.0, 350.0), (0.0, 180.0)], "a double, b double")
    assert [r[0] for r in df.select(geo.turn_deg(F.col("a"), F.col("b"))).collect()] == [20.0, 20.0, 180.0]
    assert [r[0] for r in df.select(geo.turn_deg_wrapped(F.col("a"), F.col("b"))).collect()] == [20.0, 20.0, 180.0]


def test_gaps_are_capped_and_add_up(spark):
    w = rows(K.time_weights(trip(spark, [(0, 0, 0), (600, 0, 0), (1201, 0, 0), (1261, 0, 0)])), "time_hours")
    assert sum(x[0] for x in w) == pytest.approx((600 + 600 + 60) / 3600)
    assert w[0][0] == pytest.approx(300 / 3600)


def test_half_open_window(spark):
    df = K.kinematics(trip(spark, [(0, 0, 0), (300, 0.01, 0), (600, 0.03, 0)]))
    speeds = [x[0] for x in rows(df, "speed_kmh")]
    mean = [x[0] for x in rows(R.time_stats(df), "speed_kmh_mean")]
    assert mean[1] == pytest.approx((speeds[1] + speeds[2]) / 2)  # five minutes before is out, five minutes after is in
    assert mean[0] == pytest.approx((speeds[0] + speeds[1]) / 2)


def loop(states, m):
    """Left to right over runs; a run after the first change that is too short and not the last takes the state before it."""
    runs, out = [], []
    for s in states:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    last = None
    for j, (s, n) in enumerate(runs):
        if j == 0 or n >= m or (j == 1 and len(runs) == 2):
            last = s
        elif j == 1:
            last = 1 - s
        out += [last] * n
    return out


@pytest.mark.parametrize(("states", "expected"), [("0001010111", "0000000111"), ("011", "011"), ("00001", "00001"), ("01000", "00000"), ("1111", "1111")])
def test_smoothing_examples(spark, states, expected):
    assert "".join(map(str, loop([int(c) for c in states], 3))) == expected
    df = trip(spark, [(i, 0, 0) for i in range(len(states))]).withColumn("is_fishing", F.substring(F.lit(states), F.col("event_id").cast("int") + 1, F.lit(1)).cast("int"))
    assert "".join(str(x[0]) for x in rows(smooth(df), "is_fishing")) == expected


def test_smoothing_random(spark):
    rng = random.Random(2)
    data, want = [], {}
    for t in range(120):
        s = [rng.randint(0, 1) for _ in range(rng.randint(1, 25))]
        want[t] = loop(s, 3)
        data += [(t, i, i, 0.0, 0.0, x) for i, x in enumerate(s)]
    got = {}
    for t, x in rows(smooth(spark.createDataFrame(data, SCHEMA + ", is_fishing int")), "trip_id", "is_fishing"):
        got.setdefault(t, []).append(x)
    assert got == want


def test_calendar(spark):
    df = spark.createDataFrame([(m, h) for m, h in zip([None, *range(1, 13)], [5, 6, 17, 18, 0, 1, 2, 3, 4, 7, 8, 9, 23], strict=True)], "m int, h int")
    r = df.select(temporal.monsoon(F.col("m")), temporal.landing_season(F.col("m")), temporal.day_night(F.col("h")), temporal.is_daytime(F.col("h"), True), temporal.is_daytime(F.col("h"), False)).collect()
    assert r[0][0] is None and r[0][1] == "NE Monsoon (JF)"
    assert [x[0] for x in r[1:]] == ["NE_Monsoon"] * 3 + ["Inter_Monsoon"] + ["SE_Monsoon"] * 5 + ["Inter_Monsoon"] + ["NE_Monsoon"] * 2
    assert [x[2] for x in r[:4]] == ["night", "day", "day", "night"]
    assert [x[3] for x in r[:4]] == [0, 1, 1, 1] and [x[4] for x in r[:4]] == [0, 1, 1, 0]


def test_radius_shape_finds_all_neighbours(spark):
    rng = random.Random(1)
    points = [(i * 60, 45 + rng.uniform(-3, 3) if i % 9 == 0 else 45 + rng.uniform(-0.01, 0.01), 10 + rng.uniform(-0.02, 0.02)) for i in range(60)]
    got = rows(R.near_shape(trip(spark, points), 1.0, planar=False), "n_near")
    assert [x[0] for x in got] == [sum(hav(a, b, c, d) <= 1 for _, c, d in points) for _, a, b in points]


def test_columns(spark):
    r = ColumnResolver({"latitude": ["breite"]})
    df = spark.createDataFrame([(1.0, 2.0, "2024-01-01 00:01:00", 5)], "breite double, Lng double, Time string, Trip long")
    assert r.spatial(df) == ("breite", "Lng") and r.trip(df) == "Trip"
    with pytest.raises(ValueError, match="effort"):
        r.mapping(df, ["effort", "trip_id"])
    with pytest.raises(ValueError, match="nope"):
        r.resolve(df, "latitude", "nope")
    assert ColumnResolver().find(df, "latitude") is None  # the alias belongs to r only
    assert r.standardize(df, ["latitude", "trip_id"]).columns == ["latitude", "Lng", "Time", "trip_id"]
    assert r.rename(df, {"latitude": "breite"}, drop_others=True).columns == ["latitude"]
    assert r.validate(df, ["latitude"], ["speed"]) == {"latitude": True, "speed": False}
    p = as_points(df, resolver=r).first()
    assert (p.trip_id, p.t_us, p.latitude, p.longitude) == (5, 60_000_000, 1.0, 2.0)
    bad = spark.createDataFrame([(1.0, 2.0, "not a time")], "lat double, lon double, time string")
    assert as_points(bad).first().t_us is None and as_points(bad).first().trip_id == 1


def test_configurations(spark, tmp_path):
    c = EffortClassifier(CONFIGS["gillnet"])
    c.save_config(str(tmp_path / "c.json"))
    assert EffortClassifier.load_config(str(tmp_path / "c.json")).rules == c.rules
    with pytest.raises(TypeError):
        Rules.of({"no_such": 1})
    with pytest.raises(ValueError):
        classify(trip(spark, [(0, 0, 0)]), "none")


def test_score_bounds_and_variants(spark):
    rng = random.Random(8)
    lat, lon, pts = -6.0, 39.0, []
    for i in range(80):
        lat, lon = lat + rng.uniform(-0.004, 0.004), lon + rng.uniform(-0.004, 0.004)
        pts.append((i * 120, lat, lon))
    for v in ("row_frames", "great_circle", "planar", "phase_aware"):
        out = rows(classify(trip(spark, pts), v), "fishing_score", "is_fishing", "straightness", "turn_angle")
        assert len(out) == 80 and all(0 <= s <= 1 and f in (0, 1) and 0 <= t <= 180 for s, f, _, t in out)
        if v != "phase_aware":
            assert all(x[2] <= 1 + 1e-9 for x in out)


def test_shore(spark, tmp_path):
    square = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]],[[0.4,0.4],[0.6,0.4],[0.6,0.6],[0.4,0.6],[0.4,0.4]]]}},{"type":"Feature","geometry":{"type":"LineString","coordinates":[[5,5],[6,5]]}}]}'
    (tmp_path / "coast.json").write_text(square)
    coast = S.read_segments(spark, str(tmp_path / "coast.json"))
    land = S.read_segments(spark, str(tmp_path / "coast.json"), land_only=True)
    assert (coast.count(), land.count(), S.crop(coast, (4, 6, 4, 7)).count()) == (9, 8, 1)
    df = trip(spark, [(0, 0.2, 0.2), (1, 0.5, 0.5), (2, 2, 2), (3, 5.001, 5.5)]).withColumn("is_fishing", F.lit(1))
    out = rows(S.coast_filter(df, coast, land, 1.0), "is_on_land", "is_near_shore", "is_fishing_filtered", "dist_to_shore_km")
    assert [x[:3] for x in out] == [(True, 0, 0), (False, 0, 1), (False, 0, 1), (False, 1, 0)]
    assert out[3][3] == pytest.approx(0.111)
    idle = rows(S.coast_filter(df.withColumn("is_fishing", F.lit(0)), coast, land), "dist_to_shore_km", "is_on_land")
    assert set(idle) == {(999.0, False)}
    with pytest.raises(ValueError):
        S.add_shore_filtering(df, "nowhere", method="harbor")
    with pytest.raises(ValueError):
        S.add_shore_filtering(df, "wio", method="other")
    near = rows(S.harbor_filter(df.withColumn("s", F.lit(1.0)), [(0.2, 0.2)], 1.0, 60.0, score="s"), "is_near_shore", "is_fishing_filtered", "shore_score")
    assert near[0] == (1, 0, None) and near[1][0] == 0 and 0 < near[1][2] < 1


def test_joined_coast_gives_distances_however_far(spark, monkeypatch):
    rng = random.Random(4)
    points = [(i, rng.uniform(-9, 3), rng.uniform(36, 45)) for i in range(60)] + [(60, 80.0, -170.0), (61, -0.1, 40.0)]
    df = trip(spark, points).withColumn("is_fishing", F.lit(1))
    edges = [(x, y, x + rng.uniform(-0.3, 0.3), y + rng.uniform(-0.3, 0.3)) for x, y in ((rng.uniform(38, 41), rng.uniform(-7, -4)) for _ in range(25))]
    coast = spark.createDataFrame(edges, "x1 double, y1 double, x2 double, y2 double")
    want = rows(S.coast_filter(df, coast, coast), "event_id", "dist_to_shore_km", "is_on_land", "is_fishing_filtered")
    monkeypatch.setattr(S, "SMALL", 10)
    got = rows(S.coast_filter(df, coast, coast), "event_id", "dist_to_shore_km", "is_on_land", "is_fishing_filtered")
    assert [x[1] for x in got] == pytest.approx([x[1] for x in want])
    assert [(x[0], *x[2:]) for x in got] == [(x[0], *x[2:]) for x in want]


def test_joined_land_equals_the_even_odd_rule(spark):
    import math
    import random

    rng = random.Random(4)
    rings = []
    for k in range(4):  # stars, some within others, some long and slanting
        cx, cy, n = rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3), 24
        at = [(cx + (0.05 + 0.3 * rng.random()) * math.cos(6.2831853 * i / n), cy + (0.05 + 0.3 * rng.random()) * math.sin(6.2831853 * i / n)) for i in range(n)]
        rings += [(*a, *b) for a, b in zip(at, at[1:] + at[:1], strict=True)]
    land = spark.createDataFrame(rings, "x1 double, y1 double, x2 double, y2 double")
    points = [(1, i, i, rng.uniform(-0.7, 0.7), rng.uniform(-0.7, 0.7), 1) for i in range(400)] + [(1, 900, 1, None, 0.0, 1), (None, None, 2, 0.1, 0.1, 1), (None, None, 2, 0.1, 0.1, 1), (1, 901, 3, 0.0, 0.0, 0)]
    df = spark.createDataFrame(points, "trip_id long, event_id long, t_us long, latitude double, longitude double, is_fishing int")
    columns = ["trip_id", "event_id", "is_on_land", "is_near_shore", "dist_to_shore_km"]
    few, many = (sorted(map(str, S.coast_filter(df, land, land, few=n).select(*columns[:4], F.round(columns[4], 6)).collect())) for n in (2000, 0))
    assert few == many and len(few) == len(points)
    assert 40 < sum("is_on_land=True" in r for r in few) < 360


def test_unknown_regions_are_errors(spark):
    df = spark.createDataFrame([(1, 1, 0, -6.8, 39.2, 1)], "trip_id long, event_id long, t_us long, latitude double, longitude double, is_fishing int")
    coast = spark.createDataFrame([(39.0, -6.0, 39.1, -6.1)], "x1 double, y1 double, x2 double, y2 double")
    for method in ("coastline", "harbor"):
        with pytest.raises(ValueError, match="atlantis"):
            S.add_shore_filtering(df, "atlantis", method=method, coast=coast)
    assert S.add_shore_filtering(df, "tanzania", method="harbor").first().dist_to_shore_km < 5


def test_near_shape_keeps_all_rows(spark):
    rows = [(1, k, k, 0.001 * k, 0.0) for k in range(5)] + [(1, 2, 2, 0.002, 0.0), (1, 9, 9, None, 0.0), (1, 10, 10, float("nan"), 0.0)] + [(None, k, k, 0.001 * k, 0.0) for k in range(3)]
    df = spark.createDataFrame(rows, "trip_id long, event_id long, t_us long, latitude double, longitude double")
    for planar in (True, False):
        out = R.near_shape(df, 1.0, planar).collect()
        assert len(out) == len(rows)
        near = sorted((r.trip_id is None, r.event_id, r.n_near, round(r.straightness, 6)) for r in out)
        assert near == [(False, k, 6, 1.0) for k in (0, 1, 2, 2, 3, 4)] + [(False, 9, 0, 1.0), (False, 10, 0, 1.0)] + [(True, k, 3, 1.0) for k in range(3)]
