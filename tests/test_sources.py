"""Files, the trip catalog, models' round trips, layers, the stream and the command line."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from tidewake.operators import hexgrid as H
from tidewake.operators import layers
from tidewake.operators import ml as M
from tidewake.sources import catalog
from tidewake.sources.files import read_table, write_table
from tidewake.sources.tables import stamp

POINTS = "trip_id long, event_id long, t_us long, latitude double, longitude double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("trips")
    for i in (7, 12, 101):
        df = spark.range(i).select(F.lit(i).alias("trip"), stamp("id * 60000000").alias("timestamp"), (F.col("id") / 1000 - 6).alias("latitude"), (F.col("id") / 500 + 39).alias("longitude"))
        df.coalesce(1).write.parquet(str(top / f"x{i}"))
        part = next((top / f"x{i}").glob("part-*.parquet"))
        shutil.move(part, top / f"pds-tracks_{i}.parquet")
        shutil.rmtree(top / f"x{i}")
    return str(top)


def test_catalog(spark, folder):
    c = catalog.TripCatalog(spark, folder)
    assert c.ids() == ["7", "12", "101"]
    assert c.load(12.0).count() == 12 and c.load("7").count() == 7
    with pytest.raises(FileNotFoundError, match="101"):
        c.load(5)
    assert c.load_many([7, 999, "12"]).count() == 19 and len(c.load_many([7, 12], combine=False)) == 2
    with pytest.raises(ValueError):
        c.load_many([1, 2])
    assert c.load_all().count() == 120 and c.load_all(max_trips=2).count() == 19
    assert c.load_random(2, seed=4).count() == c.load_random(2, seed=4).count()
    s = {r.trip_id: r for r in c.summarize().collect()}
    assert s["101"].n_points == 101 and s["7"].duration_hours == pytest.approx(0.1) and s["12"].max_longitude == pytest.approx(39.022)
    assert c.find(min_points=10) == ["101", "12"] and c.find(max_duration_hours=0.15) == ["7"]
    info = c.info(12)
    assert info["n_points"] == 12 and info["columns"] == ["trip", "timestamp", "latitude", "longitude"]


def test_sync(spark, folder, tmp_path):
    (tmp_path / "here").mkdir()
    shutil.copy(f"{folder}/pds-tracks_7.parquet", tmp_path / "here")

    def copy(a, b):
        if "101" in a:
            raise OSError("no")
        shutil.copy(a.removeprefix("file:"), b)

    r = catalog.sync(spark, folder, str(tmp_path / "here"), copy)
    assert (r.copied, r.skipped, len(r.failed)) == (["pds-tracks_12.parquet"], ["pds-tracks_7.parquet"], 1)
    assert r.success_rate == pytest.approx(1 / 3) and "1 copied" in r.summary()
    both = catalog.sync_countries(spark, {"a": folder, "b": str(tmp_path / "nowhere")}, str(tmp_path / "new"), lambda a, b: None)
    assert len(both["a"].copied) == 3 and both["b"].failed == ["ALL"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    for name in ("t.parquet", "t.csv"):
        write_table(df, str(tmp_path / "deep" / name))
        assert read_table(spark, str(tmp_path / "deep" / name)).collect() == df.collect()
    (tmp_path / "b.csv").write_bytes("﻿BMU;CPUA\nx;1,5\n".encode())
    assert read_table(spark, str(tmp_path / "b.csv"), sep=";").columns == ["BMU", "CPUA"]
    for f in (lambda: read_table(spark, "x.xls"), lambda: write_table(df, "x.xls")):
        with pytest.raises(ValueError):
            f()


def test_models_round_trip(spark, tmp_path):
    rows = [(i, float(i % 10) + (5 if i % 2 else 0), float(i % 7), 1.0 + (i % 2) * 3, "nets" if i % 2 else "lines") for i in range(80)]
    t = spark.createDataFrame(rows, "trip_id long, duration_hours double, distance_nm double, mean_sog double, gear_label string")
    m = M.GearModel().fit(t)
    assert m.classes == ["lines", "nets"]
    m.save(str(tmp_path / "gear"))
    out = M.GearModel.load(str(tmp_path / "gear")).predict(t)
    assert out.columns == [*t.columns, "gear_pred"] and out.where("gear_pred = gear_label").count() == 80
    with pytest.raises(RuntimeError):
        M.VesselModel().predict(t)
    p = spark.range(300).select((F.col("id") % 3).alias("trip_id"), F.col("id").alias("event_id"), (F.col("id") * 60_000_000).alias("t_us"), (F.col("id") / 1e3).alias("latitude"), (F.rand(1) / 10).alias("longitude"), F.when(F.col("id") % 2 == 0, "Fishing").otherwise("Sailing").alias("Activity"))
    f = M.EffortForest(trees=3, depth=4).fit(p)
    out = f.predict(p)
    assert {r[0] for r in out.select("effort_pred").distinct().collect()} <= {0, 1} and out.where("effort_prob < 0 or effort_prob > 1").count() == 0
    assert json.loads(M.ModelCard("rf", "effort", metrics={"f1": 0.5}).to_row())["metrics"] == {"f1": 0.5}


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, g string")
    r = {x.label: x for x in M.class_report(df, "t", "g").collect()}
    assert (r["a"].precision, r["a"].recall, r["b"].precision, r["c"].f1) == (1.0, 0.5, pytest.approx(1 / 3), 0.0)
    m = M.metrics(df, "t", "g").first()
    assert m.accuracy == 0.5 and m.macro_f1 == pytest.approx((2 / 3 + 0.5 + 0) / 3) and m.n == 4


def test_hexagons(spark):
    import random

    rng = random.Random(3)
    pts = [(rng.uniform(-7, -5), rng.uniform(38, 40)) for _ in range(300)]
    for res in (6, 7, 9):
        df = H.with_cell(spark.createDataFrame(pts, "latitude double, longitude double"), res)
        lat, lon = H.center(F.col("q"), F.col("r"), res)
        far = F.sqrt(F.pow((F.col("latitude") - lat) * 111, 2) + F.pow((F.col("longitude") - lon) * 111, 2))
        assert df.agg(F.max(far)).first()[0] <= H.edge_km(res) * (1 + 1e-9)  # no point is farther from its centre than a corner
        area = 3 * 3**0.5 / 2 * H.edge_km(res) ** 2
        assert area == pytest.approx(H.AREAS.get(res, 5.16 * 7))


def test_dashboard_and_layers(spark, tmp_path):
    p = spark.range(50).select((F.col("id") % 2).alias("trip_id"), F.col("id").alias("event_id"), (F.col("id") * 60_000_000).alias("t_us"), (F.col("id") / 1e3 - 6).alias("latitude"), F.lit(39.0).alias("longitude"), F.lit(5.0).alias("speed"), (F.col("id") % 10 < 5).cast("int").alias("is_fishing"))
    points = H.fishing_points(p, stamp())
    H.write_dashboard(points, "here", str(tmp_path))
    doc = json.loads(spark.read.text(str(tmp_path / "dashboard_here")).first()[0])
    assert doc["meta"]["country"] == "here" and doc["meta"]["total_points"] == 25 and set(doc["data"]) == {"7", "8"}
    assert {r["h"] for r in doc["data"]["7"]} == set(doc["centers"]["7"]) == set(doc["boundaries"]["7"])
    assert all(len(b) == 6 for b in doc["boundaries"]["8"].values())
    kept = H.run_hex(p, stamp(), (7,), output=str(tmp_path / "hex"))[7]
    assert spark.read.parquet(str(tmp_path / "hex" / "hex_res7")).count() == kept.count() > 0
    lines = layers.lines(p)
    f = json.loads(layers.line_features(lines).first()[0])
    assert f["geometry"]["type"] == "LineString" and len(f["geometry"]["coordinates"]) > 1
    assert json.loads(layers.point_features(p, "trip_id").first()[0])["geometry"]["coordinates"][0] == 39.0
    ring = json.loads(layers.hex_features(kept, 7, "cell").first()[0])["geometry"]["coordinates"][0]
    assert len(ring) == 7 and ring[0] == ring[-1]


def test_stream_of_trips(spark, tmp_path):
    from tidewake.streaming.trips import trip_sessions

    rows = [(v, f"2024-01-01 {h:02d}:{m:02d}:00") for v, h, m in [(1, 0, 0), (1, 0, 20), (1, 3, 0), (2, 0, 5), (1, 9, 0)]]
    spark.createDataFrame(rows, "v int, t string").select("v", F.to_timestamp("t").alias("t")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("v int, t timestamp").parquet(str(tmp_path / "in"))
    q = trip_sessions(s, "v", "t").writeStream.outputMode("append").format("memory").queryName("trips").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.v, r.n_points) for r in spark.table("trips").collect())
    assert (1, 2) in got and (2, 1) in got


def test_command_line(spark, folder, tmp_path, capsys):
    from tidewake import cli

    assert cli.main([]) == 0 and "effort" in capsys.readouterr().out
    with pytest.raises(SystemExit) as e:
        cli.main(["effort", "predict", "--help"])
    assert e.value.code == 0 and "--input" in capsys.readouterr().out
    assert cli.main(["effort", "predict", "--input", f"{folder}/pds-tracks_12.parquet", "--output", str(tmp_path / "o.parquet")]) == 0
    assert {"is_fishing", "fishing_score"} <= set(spark.read.parquet(str(tmp_path / "o.parquet")).columns)
    with pytest.raises(SystemExit):
        cli.main(["gear", "predict", "--input", f"{folder}/pds-tracks_12.parquet", "--output", "x.csv"])


def test_staged_tables_can_be_removed(spark):
    from pathlib import Path

    from tidewake.sources import staging

    a, b = (staging.staged(spark.range(n), "t") for n in (3, 5))
    folders = [Path(x._staged_path.removeprefix("file:")) for x in (a, b)]
    assert a.count() == 3 and all(f.is_dir() for f in folders)
    staging.drop_staged(a)
    assert [f.exists() for f in folders] == [False, True] and b.count() == 5
    small = staging.beside(spark.range(4).withColumnRenamed("id", "k"))
    assert spark.range(10).withColumnRenamed("id", "k").join(small, "k").count() == 4


def test_sync_keeps_the_cause_and_names_buckets(spark, tmp_path, monkeypatch):
    both = catalog.sync_countries(spark, {"b": str(tmp_path / "nowhere")}, str(tmp_path / "new"), lambda a, b: None)
    assert both["b"].failed == ["ALL"] and "nowhere" in both["b"].error
    asked = []
    monkeypatch.setattr(catalog, "sync", lambda spark, remote, local, copy: asked.append((remote, local)))
    catalog.sync_country(spark, "kenya", "/data", None)
    catalog.sync_country(spark, "kenya", "/data/", None, bucket="own", prefix="/a/b/", scheme="s3a")
    assert asked == [("gs://pds-kenya", "/data/kenya"), ("s3a://own/a/b", "/data/kenya")]


def test_missing_trips_are_warned_of(spark, folder):
    with pytest.warns(UserWarning, match="999"):
        assert catalog.TripCatalog(spark, folder).load_many([7, 999]).count() == 7


def test_dashboards_are_replaced_by_country(spark, tmp_path):
    def documents(*rows):
        return spark.createDataFrame([(json.dumps({"meta": {"country": c, "total_points": n}, "data": {"7": [{"h": "h7_1_1", "fh": float(n)}]}}),) for c, n in rows], "document string")

    held = H.load_dashboards(documents(("kenya", 1), ("zanzibar", 2)))
    now = H.replace_dashboards(held, H.load_dashboards(documents(("kenya", 9), ("wio", 3))))
    assert sorted((r.country, r.total_points) for r in now.collect()) == [("kenya", 9), ("wio", 3), ("zanzibar", 2)]
    assert sorted(r.country for r in H.remove_dashboard(now, "wio").collect()) == ["kenya", "zanzibar"]
    rows = H.dashboard_rows(now).where("country = 'kenya'").collect()
    assert [(r.res, r.h, r.fh) for r in rows] == [("7", "h7_1_1", 9.0)]


def test_coast_tables_and_the_classifiers_shore_step(spark, tmp_path):
    from tidewake.operators import shore as S
    from tidewake.operators.rules import Rules
    from tidewake.plans.effort import EffortClassifier, classify

    ring = [[39.0, -6.0], [39.2, -6.0], [39.2, -5.8], [39.0, -5.8], [39.0, -6.0]]
    (tmp_path / "coast.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    told = S.install_coast(spark, str(tmp_path / "coast.json"), str(tmp_path / "coast.parquet"))
    assert (told["segments"], told["rings"], told["min_lat"], told["max_lon"]) == (4, 1, -6.0, 39.2)
    points = spark.createDataFrame([(1, i, i * 60_000_000, -5.9 + 0.001 * i, 39.1 + 0.01 * i) for i in range(30)], POINTS)
    files = {"enable_shore_filtering": True, "shore_coastline_shapefile": str(tmp_path / "coast.parquet"), "shore_land_shapefile": str(tmp_path / "coast.json"), "shore_filter_only_fishing": False}
    out = {r.event_id: r for r in classify(points, "planar", Rules.of(files)).collect()}
    assert out[0].is_on_land and not out[20].is_on_land and out[20].dist_to_shore_km == pytest.approx(0.1 * 111, rel=1e-6)
    assert all(r.is_fishing_filtered == (0 if r.is_on_land or r.is_near_shore else r.is_fishing) for r in out.values())
    for bad in ({"shore_filter_region": "atlantis", **files}, {"enable_shore_filtering": True}, {"enable_shore_filtering": True, "shore_filter_method": "other"}, {"enable_shore_filtering": True, "shore_filter_method": "harbor"}):
        with pytest.raises(ValueError):
            EffortClassifier(bad).predict(points)


def test_one_trip_must_be_there(spark):
    from tidewake.operators.summary import one_trip

    df = spark.createDataFrame([(1, 1, 0, 0.0, 0.0)], POINTS)
    assert one_trip(df, 1).count() == 1
    with pytest.raises(ValueError, match="2"):
        one_trip(df, 2)
