import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators.nearby import Track, great_circle
from tidewake.operators.rolling import near_shape

RNG = np.random.default_rng(11)


def made(kind, n):
    steps = RNG.normal(0, 0.002, (2, n))
    lat, lon = {
        "walk": lambda: -6 + np.cumsum(steps, axis=1),
        "jitter": lambda: RNG.uniform(0, 0.012, (2, n)),
        "anchor": lambda: RNG.normal(0, 0.0001, (2, n)),
        "globe": lambda: np.array([RNG.uniform(-80, 80, n), RNG.uniform(-180, 180, n)]),
        "two places": lambda: RNG.integers(0, 2, n) * 30 + RNG.uniform(0, 0.012, (2, n)),
        "stops": lambda: -6 + np.cumsum(steps * (np.arange(n) % 200 < 60), axis=1),
    }[kind]()
    return lat, lon, RNG.integers(1, 3, n)


def plain(track, w):
    out = []
    for i in range(track.n):
        j = np.flatnonzero(track.near(np.full(track.n, i), np.arange(track.n)))
        n, p, l = w[j].sum(), track.p[j], track.l[j]  # noqa: E741
        center = np.radians((np.stack([track.lat, track.lon])[:, j] * w[j]).sum(axis=1) / n)
        off = great_circle(p, l, *center)
        path, chord = great_circle(p[:-1], l[:-1], p[1:], l[1:]).sum(), great_circle(p[0], l[0], p[-1], l[-1])
        one = n < 2
        out.append((n, 1 if one or path == 0 else chord / path, 0 if one else np.sqrt((w[j] * off**2).sum() / n), 1 if one or chord <= 0.001 else min(max(path / chord, 1), 10)))
    return np.array(out, float).T


@pytest.mark.parametrize("kind", ["walk", "jitter", "anchor", "globe", "two places", "stops"])
def test_trees_and_matrices_against_single_points(kind):
    for n in (1, 2, 90, 700):
        for planar in (True, False):
            for radius in (1.0, 0.2, 2000.0):
                lat, lon, w = made(kind, n)
                track = Track(lat, lon, w, radius, planar, lat.mean())
                assert np.abs(np.array(track.shapes(), float) - plain(track, w)).max() < 1e-8


def test_a_vessel_at_anchor_is_told_by_few_nodes():
    lat, lon, w = made("anchor", 20_000)
    track = Track(lat, lon, w, 1.0, True, lat.mean())
    began = time.process_time()
    n, *_ = track.shapes()
    assert (n == w.sum()).all() and time.process_time() - began < 10
    rows, nodes = track._elements(np.arange(100))
    assert len(nodes) == 100  # one node each: the whole trip


def test_frames_with_repeated_rows_and_missing_places(spark):
    rows = [(1, i, i * 1_000_000, -6.0 + 0.001 * i, 39.0, i) for i in range(5)] * 2
    rows += [(1, 9, 500, None, 39.0, 9), (1, 10, 600, -6.0, float("nan"), 10), (None, 1, 0, -6.0, 39.0, 1), (None, 2, 1, -6.0, 39.0, 2), (2, 1, 0, None, None, 3)]
    df = spark.createDataFrame(rows, "trip_id long, event_id long, t_us long, latitude double, longitude double, sinuosity int")
    out = near_shape(df.repartition(3), 1.0)
    assert sorted(out.columns) == sorted([*df.columns, "n_near", "straightness", "radius_gyration_km"])
    got = {(r.trip_id, r.event_id): r for r in out.collect()}
    assert out.count() == len(rows)
    assert {got[1, i].n_near for i in range(5)} == {10} and got[1, 9].n_near == got[1, 10].n_near == got[2, 1].n_near == 0
    assert got[None, 1].n_near == 2 and got[None, 2].radius_gyration_km == 0
    assert abs(got[1, 2].straightness - 1) < 1e-9 and got[2, 1].sinuosity == 1.0
    assert near_shape(df.where(F.lit(False))).count() == 0
