"""Registered queries over supervised models, evaluation and catalog operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kinematics as K
from ..operators import ml as M
from ..operators.layers import lines, zoom
from ..operators.regression import SelfOrganisingMap, pca
from ..sources.catalog import missing, summarize, with_points
from ..sources.staging import staged
from ..sources.tables import stamp, table, tracks
from . import catch_queries as CQ
from . import track_sql as Q
from .effort import classify
from .track_queries import ID, labelled, r6, sql6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _activity(t: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in {"purchase": "Fishing", "click": "Searching", "view": "Sailing", "signup": "Traveling"}.items() for x in kv])
    return t.withColumn("Activity", F.element_at(names, F.col("event_type")))


_JUDGED = f"WITH {Q.TRACKS}, {Q.rules(True)}, j AS (SELECT r.is_fishing AS guess, coalesce(t.event_type IN ('purchase', 'click'), false)::INT AS truth FROM res r JOIN tracks t USING (event_id))"


def _judged(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return classify(t).select(F.col("is_fishing").alias("guess"), F.coalesce(F.col("event_type").isin("purchase", "click"), F.lit(False)).cast("int").alias("truth"))


@query(f"{_JUDGED} SELECT truth, guess, count(*) AS n FROM j GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return M.confusion(_judged(spark, sf_dir), "truth", "guess")


_REPORT = f"""{_JUDGED}, l AS (SELECT DISTINCT truth AS label FROM j UNION SELECT DISTINCT guess FROM j),
s AS (SELECT label, (SELECT count(*) FROM j WHERE truth = label) AS support, (SELECT count(*) FROM j WHERE guess = label) AS g, (SELECT count(*) FROM j WHERE truth = label AND guess = label) AS h FROM l),
p AS (SELECT label, support, CASE WHEN g > 0 THEN h / g ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN h / support ELSE 0.0 END AS recall FROM s),
rep AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM p)"""


@query(f"{_REPORT} SELECT label, support, {sql6('precision', 'recall', 'f1')} FROM rep")
def classification_report(spark, sf_dir):
    return r6(M.class_report(_judged(spark, sf_dir), "truth", "guess"))


@query(f"{_REPORT} SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, sum(support)::BIGINT AS n FROM rep")
def classification_metrics(spark, sf_dir):
    return r6(M.metrics(_judged(spark, sf_dir), "truth", "guess"))


@query(f"WITH {Q.TRACKS}, {Q.kinematics()}, x AS (SELECT *, coalesce(event_type IN ('purchase', 'click'), false)::INT AS l FROM kin) SELECT 'speed_kmh' AS feature, round(corr(speed_kmh, l), 6) AS r FROM x UNION ALL SELECT 'turn_angle', round(corr(turn_angle, l), 6) FROM x")
def feature_label_correlation(spark, sf_dir):
    return r6(M.label_correlation(labelled(K.kinematics(tracks(spark, sf_dir))), ["speed_kmh", "turn_angle"], "is_fishing"))


_LEARN = f"""WITH {Q.TRACKS}, {Q.kinematics(leg=0)},
b1 AS (SELECT * EXCLUDE (speed_kmh, acceleration, jerk, bearing, turn_angle), CASE WHEN dt_hours > 0 THEN leg_km / dt_hours END AS v, CASE WHEN lag(latitude) OVER {Q.W} IS NOT NULL THEN {Q.bearing(f'lag(latitude) OVER {Q.W}', f'lag(longitude) OVER {Q.W}', 'latitude', 'longitude')} END AS br FROM kin),
b2 AS (SELECT *, CASE WHEN dt_hours > 0 THEN (v - lag(v) OVER {Q.W}) / dt_hours END AS a, abs(fmod(fmod(br - lag(br) OVER {Q.W} + 180, 360) + 360, 360) - 180) AS turn FROM b1),
b3 AS (SELECT *, CASE WHEN dt_hours > 0 THEN (a - lag(a) OVER {Q.W}) / dt_hours END AS j, avg(v) OVER c AS vm, quantile_cont(v, 0.25) OVER c AS v25, quantile_cont(v, 0.75) OVER c AS v75, stddev_samp(v) OVER c AS vs, avg(turn) OVER c AS tm, stddev_samp(latitude) OVER c AS ls, row_number() OVER {Q.W} - 1 AS i, count(*) OVER (PARTITION BY trip_id) AS n, min(t_us) OVER (PARTITION BY trip_id) AS t1 FROM b2
  WINDOW c AS (PARTITION BY trip_id ORDER BY t_us, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
{Q.row_neighbours('tracks', 2, 2)}, {Q.shape('nb')}"""


@query(f"""{_LEARN} SELECT trip_id, event_id, round(least(60.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(v, 0))), 6) AS speed_kmh, round(least(30.0::DOUBLE, greatest(-30.0::DOUBLE, coalesce(a, 0))), 6) AS acceleration, round(least(90.0::DOUBLE, greatest(-90.0::DOUBLE, coalesce(j, 0))), 6) AS jerk, round(coalesce(turn, 0), 6) AS turn_angle,
 round(coalesce(vm, 0), 6) AS speed_kmh_mean_w, round(coalesce(v25, 0), 6) AS speed_kmh_q25_w, round(coalesce(v75, 0), 6) AS speed_kmh_q75_w, round(coalesce(vs, 0), 6) AS speed_kmh_std_w, round(coalesce(tm, 0), 6) AS turn_angle_mean_w, round(coalesce(ls, 0), 6) AS lat_std_w, round(i / n, 6) AS trip_pos_norm, round((t_us - t1) / 6e7, 9) AS time_since_start_min,
 round(straightness, 6) AS straightness_w, round(radius_gyration_km, 6) AS rog_w, coalesce(vm < 2, false)::INT AS is_stationary FROM b3 JOIN shp USING (trip_id, event_id)""")
def learned_features(spark, sf_dir):
    f = K.learned_features(tracks(spark, sf_dir))
    minutes = F.round("time_since_start_min", 9)  # no ties at nine digits
    out = r6(f.select(*ID, "speed_kmh", "acceleration", "jerk", "turn_angle", "speed_kmh_mean_w", "speed_kmh_q25_w", "speed_kmh_q75_w", "speed_kmh_std_w", "turn_angle_mean_w", "lat_std_w", "trip_pos_norm", "straightness_w", "rog_w", "is_stationary", minutes.cast("string").alias("_m")))
    return out.withColumn("time_since_start_min", F.col("_m").cast("double")).drop("_m")


_CADENCE = f"""WITH {Q.TRACKS}, {Q.kinematics(leg=0)},
g AS (SELECT trip_id, t_us // 1000000 - lag(t_us // 1000000) OVER {Q.W} AS gap FROM tracks), c AS (SELECT trip_id, coalesce(median(gap) FILTER (gap > 0), 60.0) AS cadence_s FROM g GROUP BY trip_id),
z AS (SELECT trip_id, cadence_s, greatest(3, least(25, round_even(360.0 / cadence_s, 0)::INT)) AS local_rows, greatest(3, least(25, round_even(1080.0 / cadence_s, 0)::INT)) AS shape_rows FROM c),
b1 AS (SELECT trip_id, event_id, t_us, latitude, longitude, dt_hours, CASE WHEN dt_hours > 0 THEN leg_km / dt_hours END AS v, CASE WHEN lead(latitude) OVER {Q.W} IS NOT NULL THEN {Q.bearing('latitude', 'longitude', f'lead(latitude) OVER {Q.W}', f'lead(longitude) OVER {Q.W}')} END AS br, row_number() OVER {Q.W} AS n FROM kin),
b2 AS (SELECT *, CASE WHEN dt_hours > 0 THEN (v - lag(v) OVER {Q.W}) / dt_hours END AS a, abs(fmod(fmod(br - lag(br) OVER {Q.W} + 180, 360) + 360, 360) - 180) AS turn FROM b1),
lo AS (SELECT x.trip_id, x.event_id, avg(y.v) AS vm, stddev_samp(y.v) AS vs, quantile_cont(y.v, 0.25) AS v25, quantile_cont(y.v, 0.75) AS v75, avg(y.a) AS am, avg(y.turn) AS tm, stddev_samp(y.turn) AS ts, stddev_samp(y.latitude) AS ls FROM b2 x JOIN z USING (trip_id) JOIN b2 y ON y.trip_id = x.trip_id AND y.n BETWEEN x.n - local_rows // 2 AND x.n + (local_rows - 1) // 2 GROUP BY ALL),
nb AS (SELECT x.trip_id, x.event_id, y.n AS ord, y.latitude AS lat, y.longitude AS lon FROM b2 x JOIN z USING (trip_id) JOIN b2 y ON y.trip_id = x.trip_id AND y.n BETWEEN x.n - shape_rows // 2 AND x.n + shape_rows // 2),
{Q.shape('nb')}"""


@query(f"""{_CADENCE} SELECT trip_id, event_id, round(cadence_s, 6) AS cadence_s, local_rows, shape_rows, round(least(60.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(v, 0))), 6) AS speed_kmh, round(coalesce(turn, 0), 6) AS turn_angle, round(coalesce(vm, 0), 6) AS speed_kmh_mean_w, round(coalesce(vs, 0), 6) AS speed_kmh_std_w, round(coalesce(v25, 0), 6) AS speed_kmh_q25_w, round(coalesce(v75, 0), 6) AS speed_kmh_q75_w,
 round(coalesce(am, 0), 6) AS acceleration_mean_w, round(coalesce(tm, 0), 6) AS turn_angle_mean_w, round(coalesce(ts, 0), 6) AS turn_angle_std_w, round(coalesce(ls, 0), 6) AS lat_std_w, round(straightness, 6) AS straightness_w, round(radius_gyration_km, 6) AS rog_w, coalesce(vm < 2, false)::INT AS is_stationary FROM b2 JOIN z USING (trip_id) JOIN lo USING (trip_id, event_id) JOIN shp USING (trip_id, event_id)""")
def adaptive_features(spark, sf_dir):
    f = K.adaptive_features(tracks(spark, sf_dir), 6.0, 18.0)
    return r6(f.select(*ID, "cadence_s", "local_rows", "shape_rows", "speed_kmh", "turn_angle", "speed_kmh_mean_w", "speed_kmh_std_w", "speed_kmh_q25_w", "speed_kmh_q75_w", "acceleration_mean_w", "turn_angle_mean_w", "turn_angle_std_w", "lat_std_w", "straightness_w", "rog_w", "is_stationary"))


@query(f"WITH {Q.TRACKS}, d AS (SELECT trip_id, event_id, CASE WHEN event_id % 5 > 0 THEN speed END AS altitude, CASE WHEN event_id % 6 > 0 THEN event_type END AS model FROM tracks) SELECT trip_id, event_id, round(coalesce(altitude, (SELECT median(altitude) FROM d)), 6) AS altitude, coalesce(model, 'Unknown') AS device_model, dense_rank() OVER (ORDER BY coalesce(model, 'Unknown')) - 1 AS model_enc FROM d")
def device_features(spark, sf_dir):
    t = tracks(spark, sf_dir).withColumn("altitude", F.when(F.col("event_id") % 5 > 0, F.col("speed"))).withColumn("device_model", F.when(F.col("event_id") % 6 > 0, F.col("event_type")))
    return r6(K.device_features(t).select(*ID, "altitude", "device_model", "model_enc"))


@query(f"WITH {Q.TRACKS} SELECT trip_id, event_id, coalesce(event_type IN ('purchase', 'click'), false)::INT AS is_fishing FROM tracks")
def label_mapping(spark, sf_dir):
    return _activity(tracks(spark, sf_dir)).select(*ID, M.effort_label().cast("int").alias("is_fishing"))


@query(None)
def effort_forest(spark, sf_dir):
    """Fits and applies a small forest; another random generator makes other trees, so only metrics compare."""
    t = M.EffortForest.features(_activity(tracks(spark, sf_dir)).select(*ID, "t_us", "latitude", "longitude", "Activity"))
    return M.EffortForest(trees=20, depth=8).fit(t).predict(t).select(*ID, "effort_pred", F.round("effort_prob", 6).alias("effort_prob"), M.readable().alias("label"))


def _trips(spark, sf_dir, label: str):
    t = tracks(spark, sf_dir)
    major = t.groupBy("trip_id", "event_type").agg(F.count("*").alias("n")).groupBy("trip_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias(label))
    return M.trip_features(t).join(major, "trip_id")


@query(f"WITH {Q.TRACKS}, {Q.kinematics()}, m AS (SELECT trip_id, event_type, count(*) AS n FROM tracks GROUP BY ALL), g AS (SELECT trip_id, arg_min(event_type, (-n, event_type)) AS gear_label FROM m GROUP BY trip_id), f AS (SELECT trip_id, (max(t_us) - min(t_us)) / 3.6e9 AS duration_hours, coalesce(sum(leg_km), 0) / 1.852 AS distance_nm FROM kin GROUP BY trip_id) SELECT trip_id, {sql6('duration_hours', 'distance_nm')}, round(CASE WHEN duration_hours > 0 THEN distance_nm / duration_hours ELSE 0 END, 6) AS mean_sog, gear_label FROM f JOIN g USING (trip_id)")
def trip_features(spark, sf_dir):
    return r6(_trips(spark, sf_dir, "gear_label"))


@query(None)
def gear_predictions(spark, sf_dir):
    t = staged(_trips(spark, sf_dir, "gear_label"), "trips")  # fitted, then predicted
    return M.GearModel().fit(t).predict(t).select("trip_id", "gear_label", "gear_pred")


@query(None)
def vessel_predictions(spark, sf_dir):
    t = staged(_trips(spark, sf_dir, "vessel_type_label"), "trips")  # fitted, then predicted
    out = M.VesselModel().fit(t).predict(t)
    sure = F.element_at("vessel_type_prob", F.col("vessel_type_pred"))
    return out.select("trip_id", "vessel_type_label", "vessel_type_pred", F.round(sure, 6).alias("pred_prob"))


@query(f"WITH {Q.TRACKS} SELECT trip_id, count(*) AS n_points, round((max(t_us) - min(t_us)) / 3.6e9, 6) AS duration_hours, round(min(latitude), 6) AS min_lat, round(max(latitude), 6) AS max_lat FROM tracks GROUP BY trip_id HAVING count(*) BETWEEN 40 AND 80")
def catalog_summary(spark, sf_dir):
    t = summarize(tracks(spark, sf_dir).withColumn("timestamp", stamp()), ["trip_id"])
    found = with_points(t, min_points=40, max_points=80)
    return r6(found.select("trip_id", "n_points", "duration_hours", F.col("min_latitude").alias("min_lat"), F.col("max_latitude").alias("max_lat")))


@query("SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def sync_missing(spark, sf_dir):
    """What an incremental sync would copy: ids of one side that the other lacks (all orders, and those with returned lines)."""
    remote = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return missing(remote, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")), "id")


@query(f"WITH {Q.TRACKS}, l AS (SELECT *, coalesce(event_type IN ('purchase', 'click'), false)::INT AS s FROM tracks), c AS (SELECT *, coalesce(s IS DISTINCT FROM lag(s) OVER {Q.W}, true)::INT AS chg FROM l), r AS (SELECT *, sum(chg) OVER {Q.SO_FAR} AS run FROM c) SELECT trip_id, run::BIGINT AS run, any_value(s) AS state, count(*) AS n_points, round(arg_min(longitude, t_us), 6) AS first_lon, round(arg_max(latitude, t_us), 6) AS last_lat FROM r GROUP BY trip_id, run HAVING count(*) > 1")
def polyline_layer(spark, sf_dir):
    out = lines(labelled(tracks(spark, sf_dir)))
    return r6(out.select("trip_id", F.col("run").cast("long").alias("run"), "state", F.size("points").cast("long").alias("n_points"), F.get("points", F.lit(0))["lon"].alias("first_lon"), F.element_at("points", -1)["lat"].alias("last_lat")))


@query(f"WITH {Q.TRACKS}, z AS (SELECT avg(latitude) AS a, avg(longitude) AS b, greatest(max(latitude) - min(latitude), max(longitude) - min(longitude)) AS d FROM tracks) SELECT round(a, 6) AS center_lat, round(b, 6) AS center_lon, CASE WHEN d > 10 THEN 5 WHEN d > 5 THEN 6 WHEN d > 2 THEN 7 WHEN d > 1 THEN 8 WHEN d > 0.5 THEN 9 WHEN d > 0.2 THEN 10 ELSE 11 END AS zoom FROM z")
def map_view(spark, sf_dir):
    return r6(zoom(tracks(spark, sf_dir)))


def _unit_matrix(spark, sf_dir):
    """bmu and its standardised features, a row for each unit."""
    from ..operators import catch as C
    from ..sources.tables import landings

    f = C.feature_matrix(C.working_set(landings(spark, sf_dir)), CQ.GEARS)
    rows = f.select("bmu", *CQ._FEATURES).orderBy("bmu").collect()  # a row for each unit
    x = np.array([[float(v) for v in r[1:]] for r in rows])
    return [r[0] for r in rows], (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)


@query(None)
def unit_clusters(spark, sf_dir):
    """Units on a 6 by 6 self-organising map of their standardised features; k-means (k = 4) over the map's 36 weights, whose clusters the units inherit."""
    units, z = _unit_matrix(spark, sf_dir)
    som = SelfOrganisingMap(6, 6).fit(z)
    nodes = som.weights.reshape(36, -1)
    names = [f"w{i}" for i in range(nodes.shape[1])]
    table_ = spark.createDataFrame([(i, *map(float, w)) for i, w in enumerate(nodes)], "node int, " + ", ".join(f"{n} double" for n in names))
    at = spark.createDataFrame([(u, 6 * a + b, int(a), int(b)) for u, (a, b) in zip(units, map(som.winner, z), strict=True)], "bmu string, node int, som_row int, som_col int")
    return at.join(M.k_means(table_, names).select("node", "cluster"), "node").select("bmu", "som_row", "som_col", "cluster")


@query(None)
def unit_components(spark, sf_dir):
    """Principal components of the units' standardised features: percent of variance and the largest loading's feature."""
    _, z = _unit_matrix(spark, sf_dir)
    percent, loadings, _ = pca(z)
    rows = [(k + 1, float(round(p, 6)), CQ._FEATURES[int(abs(loadings[:, k]).argmax())]) for k, p in enumerate(percent)]
    return spark.createDataFrame(rows, "component int, percent double, feature string")
