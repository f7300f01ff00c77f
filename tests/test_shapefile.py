"""Shapefiles that the tests write give the segments of the same shapes in GeoJSON."""

import json
import struct

import numpy as np
import pytest

from tidewake.operators import shore as S
from tidewake.sources.shapefile import read_shapefile, record_places

RING = [[39.0, -6.0], [39.2, -6.0], [39.2, -5.8], [39.0, -5.8], [39.0, -6.0]]
HOLE = [[39.05, -5.95], [39.05, -5.9], [39.1, -5.9], [39.05, -5.95]]
LINE = [[40.0, -4.0], [40.1, -4.1], [40.3, -4.2]]


def write(path, shapes, index=True):
    """shapes: (type code, parts), or None for an empty shape."""
    body, places, at = b"", b"", 100
    for number, shape in enumerate(shapes, 1):
        if shape is None:
            content = struct.pack("<i", 0)
        else:
            kind, parts = shape
            xy = np.concatenate(parts).astype("<f8")
            first = np.cumsum([0, *map(len, parts)])[:-1].astype("<i4")
            content = struct.pack("<i4d2i", kind, *xy.min(axis=0), *xy.max(axis=0), len(parts), len(xy)) + first.tobytes() + xy.tobytes()
            content += b"\0" * (16 + 8 * len(xy)) if kind in (13, 15) else b""  # heights
        body += struct.pack(">2i", number, len(content) // 2) + content
        places += struct.pack(">2i", at // 2, len(content) // 2)
        at += 8 + len(content)

    def head(size):
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i", 1000, 3) + b"\0" * 64

    (path.with_suffix(".shp")).write_bytes(head(100 + len(body)) + body)
    if index:
        (path.with_suffix(".shx")).write_bytes(head(100 + len(places)) + places)
    return str(path.with_suffix(".shp"))


def rings(segments):
    """Each ring's segments in order, whatever its id."""
    out = {}
    for r in segments.orderBy("ring_id", "seq").collect():
        out.setdefault(r.ring_id, []).append((r.seq, r.x1, r.y1, r.x2, r.y2))
    return sorted(out.values())


@pytest.mark.parametrize("index", [True, False])
def test_the_same_segments_as_geojson(spark, tmp_path, index):
    shapes = [(5, [RING, HOLE]), None, (3, [LINE]), (13, [LINE[::-1], LINE]), (15, [RING[::-1]])]
    path = write(tmp_path / "coast", shapes, index)
    geometries = [{"type": "Polygon", "coordinates": [RING, HOLE]}, {"type": "LineString", "coordinates": LINE}, {"type": "MultiLineString", "coordinates": [LINE[::-1], LINE]}, {"type": "Polygon", "coordinates": [RING[::-1]]}]
    (tmp_path / "coast.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g} for g in geometries]}))
    for land in (False, True):
        want = S.load_segments(spark, str(tmp_path / "coast.json"), land)
        got = S.load_segments(spark, path, land)
        assert got.columns == want.columns and rings(got) == rings(want)
    assert S.install_coast(spark, path, str(tmp_path / "coast.parquet")) == S.check_coast(S.load_segments(spark, str(tmp_path / "coast.json")))
    assert rings(read_shapefile(spark, path, split_bytes=1)) == rings(S.load_segments(spark, path))
    assert len(record_places(path)[0]) == 5


def test_partitions_boxes_and_many_records(spark, tmp_path):
    rng = np.random.default_rng(3)
    shapes = [(3, [rng.uniform(0, 1, (rng.integers(2, 30), 2)) + [i, 0] for _ in range(2)]) for i in range(300)]
    path = write(tmp_path / "many", shapes)
    df = read_shapefile(spark, path, split_bytes=4096)
    assert df.rdd.getNumPartitions() > 20
    assert df.count() == sum(len(p) - 1 for _, ps in shapes for p in ps)
    near = read_shapefile(spark, path, box=(0.0, 1.0, 100.2, 101.5))
    assert {r.k for r in near.selectExpr("ring_id >> 32 AS k").distinct().collect()} <= {99, 100, 101} and near.count() > 0
    assert rings(S.load_segments(spark, path, box=(0.0, 1.0, 100.2, 101.5))) == rings(S.crop(df, (0.0, 1.0, 100.2, 101.5)))


def test_bad_files(spark, tmp_path):
    (tmp_path / "no.shp").write_bytes(b"no shapefile at all" * 10)
    points = tmp_path / "points"
    write(points, [(3, [LINE])])
    content = struct.pack("<i2d", 1, 39.0, -6.0)
    raw = points.with_suffix(".shp").read_bytes()[:100] + struct.pack(">2i", 1, len(content) // 2) + content
    points.with_suffix(".shp").write_bytes(raw)
    points.with_suffix(".shx").unlink()
    for bad in (str(tmp_path / "no.shp"), str(points) + ".shp", str(tmp_path / "missing.shp")):
        with pytest.raises(Exception, match="no shapefile|lines and polygons only|[Nn]o such file|does not exist|cannot find"):
            read_shapefile(spark, bad).collect()
    assert read_shapefile(spark, write(tmp_path / "none", [])).count() == 0


def test_the_classifiers_shore_step_reads_shapefiles(spark, tmp_path):
    from tidewake.operators.rules import Rules
    from tidewake.plans.effort import classify

    path = write(tmp_path / "coast", [(5, [RING])])
    points = spark.createDataFrame([(1, i, i * 60_000_000, -5.9 + 0.001 * i, 39.1 + 0.01 * i) for i in range(30)], "trip_id long, event_id long, t_us long, latitude double, longitude double")
    rules = Rules.of({"enable_shore_filtering": True, "shore_coastline_shapefile": path, "shore_land_shapefile": path, "shore_filter_only_fishing": False})
    out = {r.event_id: r for r in classify(points, "planar", rules).collect()}
    assert out[0].is_on_land and not out[20].is_on_land and out[20].dist_to_shore_km == pytest.approx(0.1 * 111, rel=1e-6)
