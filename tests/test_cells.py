"""Many points in one place: cells of points against single points."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_nearby import made, plain

from tidewake.operators import nearby as N
from tidewake.operators.rolling import near_shape


@pytest.mark.parametrize("kind", ["walk", "jitter", "anchor", "globe", "two places", "stops"])
@pytest.mark.parametrize("cell, group, matrix", [(1, 4, 1 << 18), (16, 2, 40), (96, 1, 3000)])
def test_cells_against_single_points(kind, cell, group, matrix, monkeypatch):
    for name, v in {"MANY": 0, "CELL": cell, "GROUP": group, "MATRIX": matrix}.items():
        monkeypatch.setattr(N, name, v)
    for n in (1, 2, 300, 700):
        for planar in (True, False):
            for radius in (1.0, 0.2, 40.0):
                lat, lon, w = made(kind, n)
                track = N.Track(lat, lon, w, radius, planar, lat.mean())
                want, some = plain(track, w), np.arange(0, n, 3)
                assert np.abs(np.array(track.shapes(np.arange(n)), float) - want).max() < 1e-7
                assert np.abs(np.array(track.shapes(some), float) - want[:, some]).max() < 1e-7
                assert np.abs(np.array(track.shapes(), float) - want).max() < 1e-7  # where the tree doesn't help


def test_places_on_the_border_and_at_one_place(monkeypatch):
    monkeypatch.setattr(N, "MANY", 0)
    step = 1 / N.DEGREE_KM
    k = np.arange(400)
    for lat, lon in ((k % 20 * step, k // 20 % 20 * step), (np.zeros(400), k % 2 * step), (np.zeros(400), np.zeros(400))):
        track = N.Track(lat, lon, np.ones(400, int), 1.0, True, 0.0)
        assert np.abs(np.array(track.shapes(k), float) - plain(track, np.ones(400))).max() < 1e-7


def test_many_points_in_one_place_dont_meet_all_others():
    rng = np.random.default_rng(8)
    n = 60_000
    lat, lon = rng.uniform(0, 0.02, (2, n))
    track = N.Track(lat, lon, np.ones(n, int), 1.0, True, 0.01)
    began = time.process_time()
    got = track.shapes(np.arange(n))
    took = time.process_time() - began
    some, told = np.arange(0, n, 300), {}
    began = time.process_time()
    track._by_points(some, lambda i, v: told.update({i: v}))
    assert took < (time.process_time() - began) * n / len(some) / 3
    assert got[0][some].tolist() == [told[i][0] for i in some]
    assert got[2][some] == pytest.approx([np.sqrt(told[i][2] / told[i][0]) for i in some], abs=1e-8)


@pytest.mark.parametrize("planar", [True, False])
def test_parts_of_tiles_get_the_points_in_their_reach(spark, planar, monkeypatch):
    monkeypatch.setattr(N, "MANY", 100)
    rng = np.random.default_rng(9)
    rows = [(None, k, int(rng.integers(0, 500)) * 1000, float(rng.uniform(-6.02, -5.98)), float(rng.uniform(39, 39.04))) for k in range(1500)]
    df = spark.createDataFrame(rows + rows[:30], "trip_id long, event_id long, t_us long, latitude double, longitude double")
    want = near_shape(df, 1.0, planar)
    for whole, pairs in ((100, 20_000), (0, 1 << 40)):  # parts of tiles, whole tiles
        got = near_shape(df, 1.0, planar, whole=whole, pairs=pairs)
        both = got.select("event_id", *[F.col(c).alias(f"g_{c}") for c in ("n_near", "straightness", "radius_gyration_km", "sinuosity")]).distinct().join(want.distinct(), "event_id").collect()
        assert len(both) == 1500
        for r in both:
            assert [r.g_n_near, r.g_straightness, r.g_radius_gyration_km, r.g_sinuosity] == pytest.approx([r.n_near, r.straightness, r.radius_gyration_km, r.sinuosity], abs=1e-8)
