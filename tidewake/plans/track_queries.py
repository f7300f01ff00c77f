"""Registered queries over tracks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import hexgrid as H
from ..operators import kinematics as K
from ..operators import layers
from ..operators import phases as P
from ..operators import rolling as R
from ..operators import shore as S
from ..operators import smoothing as X
from ..operators import summary as A
from ..operators.rules import Rules, agreement, indicator_rates
from ..sources.tables import stamp, tracks
from . import track_sql as Q
from .effort import classify

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a function of tracks under its name, with SQL whose CTEs follow TRACKS."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(tracks(spark, sf_dir))
        ORACLES[f.__name__] = f"WITH {Q.TRACKS}{sql}" if sql.lstrip().startswith(",") else f"WITH {Q.TRACKS} {sql}"
        return f

    return add


def r6(df: DataFrame, *keys: str) -> DataFrame:
    """keys and all double columns, rounded to 6 digits."""
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


ID = ["trip_id", "event_id"]
KIN = ["leg_km", "dt_hours", "speed_kmh", "acceleration", "jerk", "bearing", "turn_angle"]


@query(f", {Q.kinematics()} SELECT trip_id, count(*) AS n_points, round(sum(leg_km), 6) AS path_km, round(avg(speed_kmh), 6) AS avg_speed_kmh, round(max(speed_kmh), 6) AS max_speed_kmh, round(avg(turn_angle), 6) AS avg_turn, round((max(t_us) - min(t_us)) / 3.6e9, 6) AS duration_hours FROM kin GROUP BY trip_id")
def trip_kinematics_summary(t):
    return r6(A.kinematics_summary(K.kinematics(t)))


@query(f", {Q.kinematics()} SELECT trip_id, event_id, {sql6('leg_km', 'dt_hours')} FROM kin")
def haversine_legs(t):
    return r6(K.legs(t).select(*ID, "leg_km", "dt_hours"))


@query(f", {Q.kinematics()} SELECT trip_id, event_id, {sql6(*KIN)} FROM kin")
def kinematics_gated(t):
    return r6(K.kinematics(t, K.GATED).select(*ID, *KIN))


@query(f", {Q.kinematics(leg=0)} SELECT trip_id, event_id, {sql6(*KIN)} FROM kin")
def kinematics_plain(t):
    return r6(K.kinematics(t, K.PLAIN).select(*ID, *KIN))


@query(f", {Q.kinematics(speed=None, accel=None, jerk=None, leg=0, gaps_only=True)} SELECT trip_id, event_id, {sql6(*KIN)} FROM kin")
def kinematics_unlimited(t):
    return r6(K.kinematics(t, K.UNLIMITED).select(*ID, *KIN))


@query(f", p AS (SELECT *, row_number() OVER {Q.W} - 1 AS i, count(*) OVER (PARTITION BY trip_id) AS n, hour({Q.stamp('t_us')}) AS h FROM tracks) SELECT trip_id, event_id, i AS point_number, n AS total_points, round(i / n, 6) AS trip_position, h::INT AS hour, (h BETWEEN 6 AND 18)::INT AS is_daytime FROM p")
def trip_positions(t):
    return r6(K.positions(t).select(*ID, "point_number", "total_points", "trip_position", "hour", "is_daytime"))


@query(f", p AS (SELECT *, row_number() OVER {Q.W} AS i, count(*) OVER (PARTITION BY trip_id) AS n, hour({Q.stamp('t_us')}) AS h FROM tracks) SELECT trip_id, event_id, i AS point_number, n AS total_points, round(i / n, 6) AS trip_position, h::INT AS hour, (h >= 6 AND h < 18)::INT AS is_daytime FROM p")
def trip_positions_from_one(t):
    return r6(K.positions(t, from_one=True).select(*ID, "point_number", "total_points", "trip_position", "hour", "is_daytime"))


_WEIGHT = f"(coalesce(least((t_us - lag(t_us) OVER {Q.W}) / 1e6, 600.0::DOUBLE), 0) * (lag(t_us) OVER {Q.W} IS NOT NULL)::INT / 2 + coalesce(least((lead(t_us) OVER {Q.W} - t_us) / 1e6, 600.0::DOUBLE), 0) * (lead(t_us) OVER {Q.W} IS NOT NULL)::INT / 2) / 3600"


@query(f"SELECT trip_id, event_id, round({_WEIGHT}, 6) AS time_hours FROM tracks")
def time_intervals(t):
    return r6(K.time_weights(t).select(*ID, "time_hours"))


_STATS = [f"{c}_{s}" for c in Q.SERIES for s in ("mean", "std", "max", "min")]


@query(f", {Q.kinematics()}, s AS (SELECT *, {Q.stats(Q.time_frame(10))} FROM kin) SELECT trip_id, event_id, {sql6(*_STATS)}, round(speed_kmh_std / (speed_kmh_mean + 0.1), 6) AS speed_cv, round(acceleration_std / (abs(acceleration_mean) + 0.1), 6) AS accel_cv FROM s")
def time_window_stats(t):
    return r6(R.time_stats(K.kinematics(t)).select(*ID, *_STATS, "speed_cv", "accel_cv"))


@query(f", {Q.kinematics()}, s AS (SELECT *, {Q.stats(Q.time_frame(5), '_5min')}, {Q.stats(Q.time_frame(30), '_30min')} FROM kin) SELECT trip_id, event_id, {sql6(*[c + x for x in ('_5min', '_30min') for c in _STATS])}, round(speed_kmh_std_5min / (speed_kmh_mean_5min + 0.1), 6) AS speed_cv_5min, round(speed_kmh_std_30min / (speed_kmh_mean_30min + 0.1), 6) AS speed_cv_30min FROM s")
def multi_scale_stats(t):
    return r6(R.time_stats(K.kinematics(t), (5.0, 30.0)).select(*ID, *[c + x for x in ("_5min", "_30min") for c in _STATS], "speed_cv_5min", "speed_cv_30min"))


_TRAIL = "(PARTITION BY trip_id ORDER BY t_us, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query(f", {Q.kinematics(speed=None, accel=None, jerk=None, leg=0, gaps_only=True)}, s AS (SELECT *, {Q.stats(_TRAIL, null_std=True)} FROM kin) SELECT trip_id, event_id, {sql6(*[f'{c}_{x}' for c in Q.SERIES for x in ('mean', 'std')])}, round(speed_kmh_std / (speed_kmh_mean + 1e-6), 6) AS speed_cv FROM s")
def trailing_stats(t):
    return r6(R.trailing_stats(K.kinematics(t, K.UNLIMITED)).select(*ID, *[f"{c}_{x}" for c in Q.SERIES for x in ("mean", "std")], "speed_cv"))


_CENTER = "(PARTITION BY trip_id ORDER BY t_us, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(f", {Q.kinematics()} SELECT trip_id, event_id, " + ", ".join(f"round(avg({c}) OVER {_CENTER}, 6) AS {c}_mean_w, round(stddev_samp({c}) OVER {_CENTER}, 6) AS {c}_std_w, round(quantile_cont({c}, 0.25) OVER {_CENTER}, 6) AS {c}_q25_w, round(quantile_cont({c}, 0.75) OVER {_CENTER}, 6) AS {c}_q75_w" for c in Q.SERIES) + " FROM kin")
def centred_quartiles(t):
    return r6(R.window_stats(K.kinematics(t), list(Q.SERIES)).select(*ID, *[f"{c}_{s}_w" for c in Q.SERIES for s in ("mean", "std", "q25", "q75")]))


_ADAPT = f"""{Q.kinematics(leg=0)},
g AS (SELECT *, row_number() OVER {Q.W} AS rn, count(*) OVER (PARTITION BY trip_id) AS n, t_us // 1000000 - lag(t_us // 1000000) OVER {Q.W} AS gap FROM kin),
m AS (SELECT *, CASE WHEN n < 2 THEN 5 ELSE greatest(3, least(25, coalesce(floor(600 / median(CASE WHEN gap > 0 THEN gap END) OVER (PARTITION BY trip_id))::INT, 25))) END AS size FROM g),
ad AS (SELECT a.trip_id, a.event_id, {", ".join(f"avg(b.{c}) AS {c}_mean, coalesce(stddev_samp(b.{c}), 0.0) AS {c}_std, max(b.{c}) AS {c}_max, min(b.{c}) AS {c}_min" for c in Q.SERIES)} FROM m a JOIN m b ON a.trip_id = b.trip_id AND b.rn BETWEEN a.rn - a.size // 2 AND a.rn + (a.size - 1) // 2 GROUP BY a.trip_id, a.event_id)"""


@query(f", {_ADAPT} SELECT trip_id, event_id, {sql6(*_STATS)}, round(speed_kmh_std / (speed_kmh_mean + 0.1), 6) AS speed_cv FROM ad")
def adaptive_row_stats(t):
    return r6(R.adaptive_stats(K.kinematics(t, K.PLAIN)).select(*ID, *_STATS, "speed_cv"))


_SHAPE = ["straightness", "radius_gyration_km", "sinuosity"]


@query(f", {Q.row_neighbours('tracks', 7, 7)}, {Q.shape('nb')} SELECT trip_id, event_id, {sql6(*_SHAPE)} FROM shp")
def row_frame_shape(t):
    return r6(R.shape(t).select(*ID, *_SHAPE))


@query(f", {Q.near_neighbours('tracks', 1.0, True)}, {Q.shape('nb')} SELECT trip_id, event_id, n_near, {sql6(*_SHAPE)} FROM shp")
def planar_radius_shape(t):
    return r6(R.near_shape(t, 1.0, True).select(*ID, "n_near", *_SHAPE))


@query(f", {Q.near_neighbours('tracks', 1.0, False)}, {Q.shape('nb')} SELECT trip_id, event_id, n_near, {sql6(*_SHAPE)} FROM shp")
def great_circle_radius_shape(t):
    return r6(R.near_shape(t, 1.0, False).select(*ID, "n_near", *_SHAPE))


_WHOLE = f"""{Q.kinematics(speed=None, accel=None, jerk=None, leg=0, gaps_only=True)},
w1 AS (SELECT *, {Q.hav('latitude', 'longitude', f'first_value(latitude) OVER {Q.WHOLE}', f'first_value(longitude) OVER {Q.WHOLE}')} AS dist_to_start_km, sum(leg_km) OVER {Q.SO_FAR} AS run_km, sum(leg_km) OVER (PARTITION BY trip_id) AS all_km,
  avg(latitude) OVER (PARTITION BY trip_id) AS clat, avg(longitude) OVER (PARTITION BY trip_id) AS clon, {Q.hav(f'first_value(latitude) OVER {Q.WHOLE}', f'first_value(longitude) OVER {Q.WHOLE}', f'last_value(latitude) OVER {Q.WHOLE}', f'last_value(longitude) OVER {Q.WHOLE}')} AS ends FROM kin),
wh AS (SELECT *, CASE WHEN leg_km IS NOT NULL THEN dist_to_start_km / (run_km + 1e-6) END AS straightness, avg({Q.hav('latitude', 'longitude', 'clat', 'clon')}) OVER (PARTITION BY trip_id) AS radius_gyration_km, coalesce(all_km, 0.0) / (ends + 1e-6) AS sinuosity FROM w1)"""


@query(f", {_WHOLE} SELECT trip_id, event_id, {sql6('dist_to_start_km', 'straightness', 'radius_gyration_km')}, round(sinuosity, 3) AS sinuosity FROM wh")
def whole_trip_shape(t):
    return r6(R.whole_trip_shape(K.kinematics(t, K.UNLIMITED)).select(*ID, "dist_to_start_km", "straightness", "radius_gyration_km", F.round("sinuosity", 3).alias("sinuosity")))


_FLAGS = ["is_fishing_speed", "is_transit_speed", "is_high_turning", "is_low_straightness", "is_high_sinuosity", "is_clustered", "is_variable_speed"]


@query(f""", {_ADAPT}, {Q.row_neighbours('tracks', 7, 7)}, {Q.shape('nb')},
fl AS (SELECT *, {Q.flags()} FROM (SELECT *, speed_kmh_std / (speed_kmh_mean + 0.1) AS speed_cv FROM ad JOIN shp USING (trip_id, event_id))),
sc AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({Q.BASE_SCORE} - 5.0 * is_transit_speed) / 12.0)) AS fishing_score FROM fl)
SELECT trip_id, event_id, {', '.join(_FLAGS)}, round(fishing_score, 6) AS fishing_score, (fishing_score >= 0.5)::INT AS is_fishing FROM sc""")
def rules_row_frames(t):
    return r6(classify(t, "row_frames").select(*ID, *_FLAGS, "fishing_score", "is_fishing"))


@query(f""", {_ADAPT}, {Q.row_neighbours('tracks', 7, 7)}, {Q.shape('nb')},
f1 AS (SELECT *, speed_kmh_std / (speed_kmh_mean + 0.1) AS speed_cv FROM ad JOIN shp USING (trip_id, event_id) JOIN (SELECT trip_id, event_id, speed_kmh AS v FROM kin) USING (trip_id, event_id)),
fl AS (SELECT *, (v BETWEEN 0.5 AND 8.0)::INT AS is_fishing_speed, (v >= 10.0)::INT AS is_transit_speed, (turn_angle_mean >= 45.0)::INT AS is_high_turning, (straightness <= 0.7)::INT AS is_low_straightness, (sinuosity >= 1.5)::INT AS is_high_sinuosity, (radius_gyration_km <= 2.0)::INT AS is_clustered, (speed_cv >= 0.8)::INT AS is_variable_speed, (v < 2.0)::INT AS is_stationary, (turn_angle_mean >= 20.0)::INT AS is_moderate_turning FROM f1),
sc AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (2.5::DOUBLE * is_fishing_speed + 2.0 * is_high_turning + 1.5 * is_low_straightness + 1.0 * is_high_sinuosity + 1.5 * is_clustered + 1.0 * is_variable_speed - 5.0 * is_transit_speed) / 9.5)) AS fishing_score FROM fl)
SELECT trip_id, event_id, {', '.join(_FLAGS)}, is_stationary, is_moderate_turning, round(fishing_score, 6) AS fishing_score, (fishing_score >= 0.5)::INT AS is_fishing FROM sc""")
def rules_instantaneous(t):
    return r6(classify(t, "instantaneous").select(*ID, *_FLAGS, "is_stationary", "is_moderate_turning", "fishing_score", "is_fishing"))


@query("SELECT trip_id, event_id, dense_rank() OVER (ORDER BY coalesce(event_type, 'Unknown')) - 1 AS code FROM tracks")
def label_encoding(t):
    from ..operators.columns import label_codes

    return label_codes(t, "event_type", "code").select(*ID, "code")


@query(f", {Q.rules(False)} SELECT trip_id, event_id, {', '.join(_FLAGS)}, is_fishing_pattern, is_search_pattern, round(fishing_score, 6) AS fishing_score, is_fishing FROM res")
def rules_great_circle(t):
    return r6(classify(t, "great_circle").select(*ID, *_FLAGS, "is_fishing_pattern", "is_search_pattern", "fishing_score", "is_fishing"))


@query(f", {Q.rules(True)} SELECT trip_id, event_id, {', '.join(_FLAGS)}, is_fishing_pattern, is_search_pattern, round(fishing_score, 6) AS fishing_score, is_fishing FROM res")
def rules_planar(t):
    return r6(classify(t, "planar").select(*ID, *_FLAGS, "is_fishing_pattern", "is_search_pattern", "fishing_score", "is_fishing"))


#: Tracks with defects over all trips: points without a coordinate, points of no trip, and repeated rows.
_DIRTY = f"""{Q.TRACKS.replace('tracks AS', 'sound AS', 1)},
dirt AS (SELECT CASE WHEN trip_id % 7 <> 3 THEN trip_id END AS trip_id, event_id, t_us, CASE WHEN event_id % 40 <> 5 THEN latitude END AS latitude, CASE WHEN event_id % 55 <> 6 THEN longitude END AS longitude, speed, event_type FROM sound),
tracks AS (SELECT trip_id AS source_trip, event_id AS source_id, coalesce(trip_id, -1) AS trip_id, row_number() OVER (ORDER BY t_us, event_id) AS event_id, t_us, latitude, longitude, speed, event_type FROM (FROM dirt UNION ALL FROM dirt WHERE event_id % 30 = 4))"""


def with_defects(t: DataFrame) -> DataFrame:
    id_ = F.col("event_id")
    t = t.withColumns({"trip_id": F.when(F.col("trip_id") % 7 != 3, F.col("trip_id")), "latitude": F.when(id_ % 40 != 5, F.col("latitude")), "longitude": F.when(id_ % 55 != 6, F.col("longitude"))})
    return t.unionByName(t.where(id_ % 30 == 4))


def defects_query(sql: str):
    """query() over with_defects() and the same rows in SQL; equal rows have numbers of their own there."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(with_defects(tracks(spark, sf_dir)))
        ORACLES[f.__name__] = f"WITH {_DIRTY}, {sql}"
        return f

    return add


def _with_all(sql: str) -> str:
    """Rules in SQL that keep points without neighbours."""
    return sql.replace("FROM tst JOIN shp USING (trip_id, event_id)", "FROM tst LEFT JOIN shp USING (trip_id, event_id)").replace("speed_cv, straightness, radius_gyration_km, sinuosity", "speed_cv, coalesce(straightness, 1.0) AS straightness, coalesce(radius_gyration_km, 0.0) AS radius_gyration_km, coalesce(sinuosity, 1.0) AS sinuosity")


@defects_query(f"{Q.near_neighbours('tracks', 1.0, True)}, {Q.shape('nb')} SELECT source_trip AS trip_id, source_id AS event_id, coalesce(n_near, 0) AS n_near, round(coalesce(straightness, 1.0), 6) AS straightness, round(coalesce(radius_gyration_km, 0.0), 6) AS radius_gyration_km, round(coalesce(sinuosity, 1.0), 6) AS sinuosity FROM tracks LEFT JOIN shp USING (trip_id, event_id)")
def planar_shape_dirty(t):
    return r6(R.near_shape(t, 1.0, True).select(*ID, "n_near", *_SHAPE))


@defects_query(f"{_with_all(Q.rules(True))} SELECT source_trip AS trip_id, source_id AS event_id, {', '.join(_FLAGS)}, is_fishing_pattern, is_search_pattern, round(fishing_score, 6) AS fishing_score, is_fishing FROM res")
def rules_planar_dirty(t):
    return r6(classify(t, "planar").select(*ID, *_FLAGS, "is_fishing_pattern", "is_search_pattern", "fishing_score", "is_fishing"))


@query(f", {Q.rules(True)}, h AS (SELECT *, least({', '.join(Q.hav('latitude', 'longitude', f'{a}::DOUBLE', f'{b}::DOUBLE') for a, b in S.HARBORS['zanzibar'])}) AS d FROM res) SELECT trip_id, event_id, is_fishing, round(d, 6) AS dist_to_shore_km, (d < 30.0)::INT AS is_near_shore, CASE WHEN d < 30.0 THEN 0 ELSE is_fishing END AS is_fishing_filtered FROM h")
def rules_planar_shore(t):
    rules = Rules.of({"enable_shore_filtering": True, "shore_filter_method": "harbor", "shore_filter_region": "zanzibar", "shore_min_distance_km": 30.0})
    return r6(classify(t, "planar", rules).select(*ID, "is_fishing", "dist_to_shore_km", "is_near_shore", "is_fishing_filtered"))


_PHASE = f"""p1 AS (SELECT trip_id, event_id, count(*) OVER (PARTITION BY trip_id) AS n, row_number() OVER {Q.W} - 1 AS i, {Q.hav('latitude', 'longitude', f'first_value(latitude) OVER {Q.WHOLE}', f'first_value(longitude) OVER {Q.WHOLE}')} AS d1, {Q.hav('latitude', 'longitude', f'last_value(latitude) OVER {Q.WHOLE}', f'last_value(longitude) OVER {Q.WHOLE}')} AS d2 FROM tracks),
p2 AS (SELECT *, CASE WHEN n >= 3 THEN i / (n - 1) ELSE 0.0::DOUBLE END AS trip_progress, CASE WHEN n >= 3 THEN d1 ELSE 0.0::DOUBLE END AS dist_to_start_km, CASE WHEN n >= 3 THEN d2 ELSE 0.0::DOUBLE END AS dist_to_end_km FROM p1),
pha AS (SELECT *, CASE WHEN n >= 3 AND (dist_to_end_km <= 1.0 OR trip_progress >= 0.95) THEN 'ending' WHEN n >= 3 AND (dist_to_start_km <= 1.0 OR trip_progress <= 0.05) THEN 'starting' ELSE 'in_progress' END AS trip_phase FROM p2)"""
_ENHANCED = f"""{_WHOLE}, tr AS (SELECT *, {Q.stats(_TRAIL, null_std=True)} FROM wh),
e1 AS (SELECT *, coalesce(speed_kmh_mean BETWEEN 0.5 AND 5.0, false)::INT AS f1, coalesce(speed_kmh_mean > 8.0, false)::INT AS f2, coalesce(turn_angle > 45.0, false)::INT AS f3, coalesce(straightness < 0.3, false)::INT AS f4, coalesce(sinuosity > 1.5, false)::INT AS f5, coalesce(radius_gyration_km < 0.5, false)::INT AS f6, coalesce(speed_kmh_std / (speed_kmh_mean + 1e-6) > 0.5, false)::INT AS f7 FROM tr),
enh AS (SELECT *, 25 * f1 + 20 * f3 + 15 * f4 + 15 * f5 + 10 * f6 + 15 * f7 AS pts FROM e1),
act AS (SELECT enh.trip_id, event_id, pts, CASE WHEN f2 = 1 THEN 0 ELSE (pts >= 50)::INT END AS is_fishing, trip_phase FROM enh JOIN pha USING (trip_id, event_id))"""


@query(f", {_ENHANCED.replace('enh AS (', _PHASE + ', enh AS (', 1)} SELECT trip_id, event_id, round(pts / 100, 6) AS fishing_score, is_fishing, trip_phase, CASE WHEN trip_phase = 'starting' THEN 'starting_trip' WHEN trip_phase = 'ending' THEN 'ending_trip' WHEN is_fishing = 1 THEN 'fishing' ELSE 'sailing' END AS activity_type FROM act")
def rules_phase_aware(t):
    return r6(classify(t, "phase_aware").select(*ID, "fishing_score", "is_fishing", "trip_phase", "activity_type"))


@query(f", {_PHASE} SELECT trip_id, event_id, {sql6('trip_progress', 'dist_to_start_km', 'dist_to_end_km')}, trip_phase FROM pha")
def trip_phases(t):
    return r6(P.phases(t).select(*ID, "trip_progress", "dist_to_start_km", "dist_to_end_km", "trip_phase"))


_LABELLED = "lab AS (SELECT *, coalesce(event_type IN ('purchase', 'click'), false)::INT AS is_fishing FROM tracks)"


def labelled(t: DataFrame) -> DataFrame:
    """purchase reads Fishing and click Searching (1); all else, unknown labels too, reads 0."""
    return t.withColumn("is_fishing", F.coalesce(F.col("event_type").isin("purchase", "click"), F.lit(False)).cast("int"))


@query(f", {_LABELLED}, {Q.smoothed('lab', 'is_fishing', 3)} SELECT trip_id, event_id, is_fishing FROM smo")
def state_smoothing(t):
    return X.smooth(labelled(t)).select(*ID, "is_fishing")


@query(f", {Q.rules(True)} SELECT trip_id, count(is_fishing) AS total_points, sum(is_fishing)::BIGINT AS fishing_points, round(avg(is_fishing), 4) AS fishing_ratio, round(avg(fishing_score), 4) AS avg_fishing_score, round(stddev_samp(fishing_score), 4) AS std_fishing_score, round(avg(speed_kmh), 4) AS avg_speed_kmh, round(max(speed_kmh), 4) AS max_speed_kmh, {Q.stamp('min(t_us)')} AS start_time, {Q.stamp('max(t_us)')} AS end_time, round((max(t_us) - min(t_us)) / 3.6e9, 6) AS duration_hours FROM res GROUP BY trip_id")
def trip_summary(t):
    return r6(A.trip_summary(classify(t)))


@query(f""", {_LABELLED}, {Q.kinematics('lab')}
SELECT trip_id, count(*) AS total_points, count(*) FILTER (is_fishing = 1) AS fishing_points, count(*) FILTER (is_fishing = 0) AS non_fishing_points, round(100 * count(*) FILTER (is_fishing = 1) / count(*), 6) AS fishing_percentage, round((max(t_us) - min(t_us)) / 3.6e9, 6) AS duration_hours,
 round(avg(speed), 6) AS avg_speed, round(max(speed), 6) AS max_speed, round(avg(speed) FILTER (is_fishing = 1), 6) AS avg_fishing_speed, round(avg(speed) FILTER (is_fishing = 0), 6) AS avg_transit_speed, round(coalesce(sum(leg_km), 0), 6) AS total_distance_km,
 round({Q.hav('arg_min(latitude, t_us)', 'arg_min(longitude, t_us)', 'arg_max(latitude, t_us)', 'arg_max(longitude, t_us)')}, 6) AS displacement_km FROM kin GROUP BY trip_id""")
def trip_statistics(t):
    return r6(A.trip_statistics(labelled(t)))


@query(f""", {Q.kinematics()}, r1 AS (SELECT *, coalesce(event_type IS DISTINCT FROM lag(event_type) OVER {Q.W}, true)::INT * (row_number() OVER {Q.W} > 1)::INT AS chg FROM kin), r2 AS (SELECT *, sum(chg) OVER {Q.SO_FAR} AS run FROM r1),
r3 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY trip_id, run ORDER BY t_us, event_id) = 1 THEN 0.0 ELSE leg_km END AS ins FROM r2)
SELECT trip_id, run::BIGINT AS run, min(event_type) AS state, count(*) AS n_points, round(sum(ins), 6) AS path_km, min(t_us) AS from_us, max(t_us) AS to_us FROM r3 GROUP BY trip_id, run HAVING count(*) > 1""")
def activity_runs(t):
    return r6(K.activity_runs(t).withColumn("run", F.col("run").cast("long")))


@query(f", a AS (SELECT trip_id, event_id, row_number() OVER {Q.W} - 1 AS nth, degrees(atan2(lead(longitude) OVER {Q.W} - longitude, lead(latitude) OVER {Q.W} - latitude)) AS arrow FROM tracks) SELECT trip_id, event_id, nth, round(arrow, 6) AS arrow FROM a WHERE nth % 10 = 0 AND arrow IS NOT NULL")
def direction_marks(t):
    return r6(K.every_kth(t).select(*ID, "nth", "arrow"))


@query(f", g AS (SELECT trip_id, t_us // 1000000 - lag(t_us // 1000000) OVER {Q.W} AS gap FROM tracks), c AS (SELECT trip_id, coalesce(median(gap) FILTER (gap > 0), 60.0) AS cadence_s FROM g GROUP BY trip_id) SELECT trip_id, round(cadence_s, 6) AS cadence_s, greatest(3, least(25, round_even(12.0 / cadence_s, 0)::INT)) AS local_rows, greatest(3, least(25, round_even(60.0 / cadence_s, 0)::INT)) AS shape_rows FROM c")
def trip_cadence(t):
    return r6(K.cadence(t))


@query(f", {Q.rules(True)} SELECT indicator, round(rate, 6) AS rate FROM (SELECT {', '.join(f'100.0 * avg({c}) AS {c}' for c in [*_FLAGS, 'is_fishing_pattern', 'is_search_pattern'])} FROM res) UNPIVOT (rate FOR indicator IN ({', '.join([*_FLAGS, 'is_fishing_pattern', 'is_search_pattern'])}))")
def rule_rates(t):
    return r6(indicator_rates(classify(t).select(*_FLAGS, "is_fishing_pattern", "is_search_pattern")))


@query(f", {Q.rules(True)}, x AS (SELECT r.is_fishing AS left_verdict, l.is_fishing AS right_verdict FROM res r JOIN (SELECT event_id, coalesce(event_type IN ('purchase', 'click'), false)::INT AS is_fishing FROM tracks) l USING (event_id)) SELECT left_verdict, right_verdict, count(*) AS n FROM x GROUP BY ALL")
def verdict_agreement(t):
    return agreement(classify(t), labelled(t))


# --- shore -----------------------------------------------------------------------------------------------------------

#: A synthetic coast for the driver's tracks: an island's ring (x, y).
ISLAND = [(39.40, -6.10), (39.55, -6.08), (39.60, -5.95), (39.52, -5.88), (39.42, -5.92), (39.40, -6.10)]
_EDGES = [(*a, *b) for a, b in zip(ISLAND, ISLAND[1:], strict=False)]


def _coast(t: DataFrame) -> DataFrame:
    return t.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e, strict=True)]) for e in _EDGES])))


_HARBOR = "least(" + ", ".join(Q.hav("latitude", "longitude", f"{a}::DOUBLE", f"{b}::DOUBLE") for a, b in S.HARBORS["zanzibar"]) + ")"


@query(f", {_LABELLED}, h AS (SELECT *, {_HARBOR} AS d FROM lab) SELECT trip_id, event_id, round(d, 6) AS dist_to_shore_km, (d < 30.0)::INT AS is_near_shore, CASE WHEN d < 30.0 THEN 0 ELSE is_fishing END AS is_fishing_filtered FROM h")
def harbor_filter(t):
    return r6(S.harbor_filter(labelled(t), S.HARBORS["zanzibar"], 30.0).select(*ID, "dist_to_shore_km", "is_near_shore", "is_fishing_filtered"))


_COAST = f"""{_LABELLED}, edges AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join(f"{v}::DOUBLE" for v in e) + ")" for e in _EDGES)}) v(x1, y1, x2, y2)),
pe AS (SELECT trip_id, event_id, is_fishing, latitude, longitude, x1, y1, x2, y2, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((longitude - x1) * (x2 - x1) + (latitude - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS u FROM lab, edges WHERE is_fishing = 1),
pd AS (SELECT trip_id, event_id, min(sqrt(pow(longitude - (x1 + u * (x2 - x1)), 2) + pow(latitude - (y1 + u * (y2 - y1)), 2))) * 111.0 AS d, count(*) FILTER ((y1 > latitude) <> (y2 > latitude) AND longitude < (x2 - x1) * (latitude - y1) / (y2 - y1) + x1) % 2 = 1 AS land FROM pe GROUP BY ALL)"""
_COAST_OUT = "SELECT trip_id, event_id, round(coalesce(d, 999.0), 6) AS dist_to_shore_km, coalesce(land, false) AS is_on_land, (coalesce(d, 999.0) < 1.0)::INT AS is_near_shore, CASE WHEN coalesce(d, 999.0) < 1.0 OR coalesce(land, false) THEN 0 ELSE is_fishing END AS is_fishing_filtered FROM lab LEFT JOIN pd USING (trip_id, event_id)"


@query(f", {_COAST} " + _COAST_OUT)
def coast_filter(t):
    return r6(S.coast_filter(labelled(t), _coast(t), _coast(t)).select(*ID, "dist_to_shore_km", "is_on_land", "is_near_shore", "is_fishing_filtered"))


@query(f", {_COAST} " + _COAST_OUT)
def coast_filter_joined(t):
    return r6(S.coast_filter(labelled(t), _coast(t), _coast(t), few=0).select(*ID, "dist_to_shore_km", "is_on_land", "is_near_shore", "is_fishing_filtered"))


@query(f", {_COAST}, cf AS ({_COAST_OUT}) SELECT trip_id, event_id, dist_to_shore_km, is_fishing_filtered FROM cf WHERE is_near_shore <> 1 AND NOT is_on_land")
def coast_clean_points(t):
    return r6(S.clean_points(S.coast_filter(labelled(t), _coast(t), _coast(t))).select(*ID, "dist_to_shore_km", "is_fishing_filtered"))


_BOX = (-6.5, -5.5, 39.0, 40.0)


@query(f", {_LABELLED}, x AS (SELECT *, trunc((latitude - (-6.5)) / 0.01)::INT AS i, trunc((longitude - 39.0) / 0.01)::INT AS j FROM lab), y AS (SELECT trip_id, event_id, is_fishing, CASE WHEN i BETWEEN 0 AND 100 AND j BETWEEN 0 AND 100 THEN {Q.hav('(-6.5::DOUBLE + i * 0.01::DOUBLE)', '(39.0::DOUBLE + j * 0.01::DOUBLE)', '(-6.1659)::DOUBLE', '39.1959::DOUBLE')} ELSE 'inf'::DOUBLE END AS d FROM x) SELECT trip_id, event_id, round(d, 6) AS dist_to_shore_km, (d < 30.0)::INT AS is_near_shore, CASE WHEN d < 30.0 THEN 0 ELSE is_fishing END AS is_fishing_filtered FROM y")
def raster_filter(t):
    grid = S.raster(t.sparkSession, _BOX, S.HARBORS["zanzibar"][:1])
    return r6(S.raster_filter(labelled(t), grid, _BOX, min_km=30.0).select(*ID, "dist_to_shore_km", "is_near_shore", "is_fishing_filtered"))


# --- hexagons --------------------------------------------------------------------------------------------------------

#: Calendar time of the track view: its half day is stretched over a year, so that all months and seasons occur.
STRETCH = 700


def hex_points(t: DataFrame) -> DataFrame:
    return H.fishing_points(labelled(K.kinematics(t)), stamp(f"t_us * {STRETCH}"))


_RES = 7
_S = H.edge_km(_RES)
_X, _Y = "(longitude * 111.0::DOUBLE)", "(latitude * 111.0::DOUBLE)"
_HEXP = f"""{_LABELLED}, {Q.kinematics("lab")}, fp AS (SELECT * EXCLUDE (is_fishing), {Q.stamp(f't_us * {STRETCH}')} AS time FROM kin WHERE is_fishing = 1),
fq AS (SELECT *, year(time)::INT AS year, month(time)::INT AS month, CASE WHEN month(time) IN (11, 12, 1, 2, 3) THEN 'NE_Monsoon' WHEN month(time) IN (4, 10) THEN 'Inter_Monsoon' ELSE 'SE_Monsoon' END AS season, CASE WHEN hour(time) >= 6 AND hour(time) < 18 THEN 'day' ELSE 'night' END AS day_night, time::DATE AS date, {_WEIGHT} AS time_hours,
  ({_X} * {3**0.5!r} / 3 - {_Y} / 3) / {_S!r} AS fq, ({_Y} * 2 / 3) / {_S!r} AS fr FROM fp),
fr AS (SELECT *, -fq - fr AS ft, floor(fq + 0.5) AS rq, floor(fr + 0.5) AS rr FROM fq),
fs AS (SELECT *, floor(ft + 0.5) AS rt, abs(rq - fq) AS dq, abs(rr - fr) AS dr, abs(floor(ft + 0.5) - ft) AS dt FROM fr),
hp AS (SELECT *, (CASE WHEN dq > dr AND dq > dt THEN -rr - rt ELSE rq END)::BIGINT AS q, (CASE WHEN dr > dt AND NOT (dq > dr AND dq > dt) THEN -rq - rt ELSE rr END)::BIGINT AS r FROM fs),
hc AS (SELECT *, 'h{_RES}_' || q || '_' || r AS cell FROM hp)"""
_MEASURES = "sum(time_hours) AS fishing_hours, count(time) AS n_points, count(DISTINCT trip_id) AS n_trips, count(DISTINCT date) AS n_days, count(DISTINCT (trip_id, date)) AS vessel_days, avg(speed_kmh) AS mean_speed_kmh, stddev_samp(speed_kmh) AS std_speed_kmh, min(time) AS first_seen, max(time) AS last_seen"


def _slice_sql(name: str, keys: list[str]) -> str:
    cols = ", ".join(k if k in keys else f"NULL AS {k}" for k in H._KEYS)
    by = ", ".join(["cell", "q", "r", *keys])
    return f"SELECT '{name}' AS slice, cell, q, r, {cols}, {_MEASURES} FROM hc GROUP BY {by}"


_HEX = f"""{_HEXP}, hs AS ({" UNION ALL BY NAME ".join(_slice_sql(n, k) for n, k in H.SLICES.items())}),
hx AS (SELECT *, n_days / (floor((epoch_us(max(last_seen) OVER p) - epoch_us(min(first_seen) OVER p)) / 86400e6) + 1) AS temporal_coverage, r * (1.5 * {_S!r} / 111.0) AS lat, (q + r / 2) * ({3**0.5!r} * {_S!r} / 111.0) AS lon, fishing_hours / n_trips AS hours_per_trip, fishing_hours / n_days AS hours_per_day FROM hs WINDOW p AS (PARTITION BY slice, year, month, season, day_night))"""
_HEX_COLS = "slice, cell, year, month, season, day_night, n_points, n_trips, n_days, vessel_days, first_seen, last_seen, " + sql6("fishing_hours", "mean_speed_kmh", "std_speed_kmh", "temporal_coverage", "lat", "lon", "hours_per_trip", "hours_per_day")


@query(f", {_HEX} SELECT {_HEX_COLS} FROM hx")
def hex_slices(t):
    return r6(H.metrics(hex_points(t), _RES, speed="speed_kmh"))


_QUALITY = f"""{_HEX}, hf AS (SELECT * FROM hx WHERE fishing_hours >= 0.1), hq AS (SELECT slice, quantile_cont(n_trips::DOUBLE, 0.75) AS qt, greatest(quantile_cont(n_days::DOUBLE, 0.75), 1.0) AS qd, quantile_cont(fishing_hours, 0.75) AS qh FROM hf GROUP BY slice),
qual AS (SELECT hf.*, (least(1.0::DOUBLE, n_trips / qt) + least(1.0::DOUBLE, n_days / qd) + least(1.0::DOUBLE, fishing_hours / qh)) / 3 AS confidence FROM hf JOIN hq USING (slice))"""


@query(f", {_QUALITY} SELECT slice, cell, year, month, season, day_night, {sql6('fishing_hours', 'confidence')} FROM qual")
def hex_quality(t):
    return r6(H.quality(H.metrics(hex_points(t), _RES, speed="speed_kmh")).select("slice", "cell", *H._KEYS, "fishing_hours", "confidence"))


@query(f", {_QUALITY} SELECT slice, count(*) AS n_hexagons, round(avg(fishing_hours), 6) AS mean_hours, round(median(fishing_hours), 6) AS median_hours, round(max(fishing_hours), 6) AS max_hours, round(sum(fishing_hours), 6) AS total_hours FROM qual GROUP BY slice")
def hex_summary(t):
    return r6(H.hex_summary(H.quality(H.metrics(hex_points(t), _RES, speed="speed_kmh"))))


@query(f", {_QUALITY} SELECT cell, round(fishing_hours, 6) AS fishing_hours, n_trips FROM qual WHERE slice = 'overall' ORDER BY qual.fishing_hours DESC, cell LIMIT 10")
def hex_top(t):
    return r6(H.top_hexagons(H.quality(H.metrics(hex_points(t), _RES, speed="speed_kmh"))))


_CUBE = f"""{_HEXP}, cub AS (SELECT cell AS h, year AS y, month AS m, day_night AS dn, round(sum(time_hours), 4) AS fh, count(DISTINCT trip_id) AS nt, count(DISTINCT date) AS nd, count(DISTINCT (trip_id, date)) AS vd, round(avg(speed_kmh), 2) AS sp, any_value(season) AS s FROM hc GROUP BY ALL)"""


@query(f", {_CUBE.replace('any_value(season) AS s FROM hc GROUP BY ALL', 'any_value(season) AS s FROM hc GROUP BY cell, year, month, day_night')} SELECT * FROM cub")
def dashboard_cube(t):
    return H.cube(hex_points(t), _RES, "speed_kmh")


@query(f", {_CUBE.replace('any_value(season) AS s FROM hc GROUP BY ALL', 'any_value(season) AS s FROM hc GROUP BY cell, year, month, day_night')} SELECT h, round(sum(fh), 6) AS fh, sum(nt)::BIGINT AS nt, sum(nd)::BIGINT AS nd, sum(vd)::BIGINT AS vd, round(sum(sp * CASE WHEN fh > 0 THEN fh ELSE 1 END) / sum(CASE WHEN sp IS NOT NULL THEN CASE WHEN fh > 0 THEN fh ELSE 1 END END), 6) AS sp FROM cub WHERE dn = 'day' GROUP BY h")
def dashboard_roll_up(t):
    return r6(H.roll_up(H.cube(hex_points(t), _RES, "speed_kmh"), dn="day"))


@query(
    f", {_HEXP} SELECT cell AS h, round(sum(time_hours), 6) AS fh, count(DISTINCT trip_id) AS nt, count(DISTINCT date) AS nd, count(DISTINCT (trip_id, date)) AS vd "
    "FROM hc WHERE season = 'NE_Monsoon' GROUP BY cell"
)
def dashboard_roll_up_exact(t):
    return r6(H.roll_up_exact(H.trip_cube(hex_points(t), _RES, "speed_kmh"), season="NE_Monsoon"))


@query(f", {_HEX}, c AS (SELECT fishing_hours AS v, row_number() OVER (ORDER BY fishing_hours) - 1 AS k, count(*) OVER () AS n FROM hx WHERE slice = 'overall' AND fishing_hours > 0) SELECT round(v, 6) AS color_max FROM c WHERE k = least(floor(n * 0.95), n - 1)")
def hex_color_max(t):
    return r6(H.color_max(H.metrics(hex_points(t), _RES, {"overall": []}), "fishing_hours"))


_MERCATOR = "0.5 - ln(tan(pi() / 4 + radians(greatest(-85.05112878, least(85.05112878, latitude))) / 2)) / (2 * pi())"


@query(
    f", {_LABELLED}, z AS (SELECT unnest(range(4, 13))::INT AS zoom), c AS (SELECT zoom, floor((longitude + 180) / 360 * pow(2, zoom + 2)) AS cx, floor(({_MERCATOR}) * pow(2, zoom + 2)) AS cy, latitude, longitude, is_fishing FROM lab, z) "
    "SELECT zoom, count(*) AS n_points, round(sum(latitude), 6) AS lat_sum, round(sum(longitude), 6) AS lon_sum, count(*) FILTER (is_fishing = 1) AS n_fishing FROM c GROUP BY zoom, cx, cy"
)
def map_clusters(t):
    """Sums of places and states: means of coordinates with six digits would lie on the edge of rounding."""
    n, out = F.col("n_points"), layers.clusters(labelled(t))
    return r6(out.select("zoom", n, (F.col("lat") * n).alias("lat_sum"), (F.col("lon") * n).alias("lon_sum"), F.round(F.col("share") * n).cast("long").alias("n_fishing")))


@query(f", {_HEXP} SELECT cell, count(*) AS n_points FROM hc GROUP BY cell")
def hex_density(t):
    return H.density(hex_points(t), _RES)


# --- rectangular grid ------------------------------------------------------------------------------------------------

_BOUNDS = "bx AS (SELECT min(latitude) - (max(latitude) - min(latitude)) * 0.05::DOUBLE AS min_lat, max(latitude) + (max(latitude) - min(latitude)) * 0.05::DOUBLE AS max_lat, min(longitude) - (max(longitude) - min(longitude)) * 0.05::DOUBLE AS min_lon, max(longitude) + (max(longitude) - min(longitude)) * 0.05::DOUBLE AS max_lon FROM tracks)"


@query(f", {_BOUNDS} SELECT {sql6('min_lat', 'max_lat', 'min_lon', 'max_lon')} FROM bx")
def grid_bounds(t):
    return r6(G.bounds(t))


def _grid_sql(agg: str) -> str:
    return f"{_BOUNDS}, gp AS (SELECT floor((latitude - min_lat) / 0.01::DOUBLE)::BIGINT AS i, floor((longitude - min_lon) / 0.01::DOUBLE)::BIGINT AS j, speed, min_lat, min_lon FROM tracks, bx), gr AS (SELECT i, j, ({agg})::DOUBLE AS value, min(min_lat) + i * 0.01::DOUBLE AS lat, min(min_lon) + j * 0.01::DOUBLE AS lon FROM gp GROUP BY i, j)"


def _grid_query(how: str, agg: str):
    def f(t):
        return r6(G.grid(t, 0.01, how, "speed"))

    f.__name__ = f"grid_{how}"
    query(f", {_grid_sql(agg)} SELECT i, j, {sql6('value', 'lat', 'lon')} FROM gr")(f)


for _how, _agg in (("sum", "sum(speed)"), ("mean", "avg(speed)"), ("count", "count(*)"), ("max", "greatest(max(speed), 0)")):
    _grid_query(_how, _agg)


@query(f", {_grid_sql('sum(speed)')}, th AS (SELECT quantile_cont(value, 0.9) AS threshold FROM gr WHERE value > 0) SELECT i, j, {sql6('value', 'lat', 'lon', 'threshold')} FROM gr, th WHERE value > 0 AND value >= threshold")
def grid_hotspots(t):
    return r6(G.hotspots(G.grid(t, 0.01, "sum", "speed")))


@query(f", {_grid_sql('sum(speed)')}, th AS (SELECT quantile_cont(value, 0.9) AS threshold, sum(value) AS total, max(value) AS max_cell FROM gr WHERE value > 0) SELECT round(total, 4) AS total, round(max_cell, 6) AS max_cell, round(threshold, 6) AS threshold, count(*) FILTER (value >= threshold) AS n_hotspots FROM gr, th WHERE value > 0 GROUP BY th.total, th.max_cell, th.threshold")
def grid_statistics(t):
    return G.grid_stats(G.grid(t, 0.01, "sum", "speed")).select(F.round("total", 4).alias("total"), F.round("max_cell", 6).alias("max_cell"), F.round("threshold", 6).alias("threshold"), "n_hotspots")


# --- filters and shares ----------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM tracks GROUP BY event_type")
def activity_shares(t):
    return r6(A.shares(t, "event_type"))


@query("SELECT trip_id, event_id FROM tracks WHERE trip_id IN (SELECT trip_id FROM tracks GROUP BY trip_id HAVING arg_min(latitude, t_us) BETWEEN -6.005 AND -5.995 AND arg_min(longitude, t_us) BETWEEN 39.495 AND 39.505)")
def trips_starting_in_box(t):
    return A.starts_in_box(t, (-6.005, -5.995, 39.495, 39.505)).select(*ID)


@query("SELECT trip_id, event_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM tracks WHERE trip_id = 5")
def one_trip(t):
    return r6(A.one_trip(t, 5).select(*ID, "latitude", "longitude"))


@query(f", {_LABELLED} SELECT trip_id, count(*) AS total_points, sum(is_fishing)::BIGINT AS fishing_points, round(avg(is_fishing), 6) AS fishing_ratio FROM lab GROUP BY trip_id")
def predicted_summary(t):
    return r6(A.predicted_summary(labelled(t), "is_fishing"))


@query(f", {_LABELLED} SELECT count(*) AS n_points, sum(is_fishing)::BIGINT AS fishing_points, round(100 * avg(is_fishing), 6) AS fishing_percent, count(DISTINCT trip_id) AS n_trips, count(DISTINCT latitude) * count(DISTINCT longitude) AS coverage FROM lab")
def layer_annotations(t):
    return r6(A.coverage(labelled(t)))
