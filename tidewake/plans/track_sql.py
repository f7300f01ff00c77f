"""The SQL that track queries are checked against: CTEs for DuckDB, written apart from the plans."""

from __future__ import annotations

TRACKS = """tracks AS (
  SELECT user_id AS trip_id, event_id, (epoch_us(ts) - 1704067200000000) // 60 AS t_us,
         (-6000000 + sum((event_id * 7919) % 20001 - 10000) OVER w)::BIGINT / 1e6 AS latitude,
         (39500000 + sum((event_id * 104729) % 20001 - 10000) OVER w)::BIGINT / 1e6 AS longitude,
         value / 10 AS speed, event_type
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
W = "(PARTITION BY trip_id ORDER BY t_us, event_id)"
SO_FAR = "(PARTITION BY trip_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
WHOLE = "(PARTITION BY trip_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def hav(a: str, b: str, c: str, d: str) -> str:
    """NULL if a coordinate is: least() passes over NULL."""
    root = f"sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))"
    return f"(12742.0::DOUBLE * asin(CASE WHEN {root} > 1 THEN 1.0::DOUBLE ELSE {root} END))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    return f"fmod(degrees(atan2(sin(radians({d}) - radians({b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b})))) + 360, 360)"


def stamp(us: str) -> str:
    return f"make_timestamp(1704067200000000 + ({us})::BIGINT)"


def limited(x: str, low, high) -> str:
    return f"CASE WHEN {x} < {low} THEN {low}::DOUBLE WHEN {x} > {high} THEN {high}::DOUBLE ELSE {x} END"


def kinematics(src: str = "tracks", speed=50, accel=30, jerk=100, leg=0.1, gaps_only=False) -> str:
    """CTEs up to `kin`."""

    def rate(change: str, limit) -> str:
        at0 = "" if gaps_only or limit is None else f" WHEN dt_hours = 0 THEN sign({change}) * {limit}"
        x = f"coalesce(CASE WHEN dt_hours > 0 THEN ({change}) / dt_hours{at0} END, 0.0::DOUBLE)"
        return x if limit is None else f"greatest(-{limit}::DOUBLE, least({limit}::DOUBLE, {x}))"

    v = "coalesce(CASE WHEN dt_hours > 0 THEN leg_km / dt_hours END, 0.0::DOUBLE)"
    v = v if speed is None else f"least({speed}::DOUBLE, {v})"
    return f"""k1 AS (SELECT *, {hav(f'lag(latitude) OVER {W}', f'lag(longitude) OVER {W}', 'latitude', 'longitude')} AS leg_raw, lag(t_us) OVER {W} AS t0 FROM {src}),
k2 AS (SELECT * EXCLUDE (leg_raw, t0), CASE WHEN t0 IS NOT NULL THEN leg_raw END AS leg_km, (t_us - t0) / 3.6e9 AS dt_hours FROM k1),
k3 AS (SELECT *, {v} AS speed_kmh FROM k2),
k4 AS (SELECT *, {rate(f'speed_kmh - lag(speed_kmh) OVER {W}', accel)} AS acceleration FROM k3),
k5 AS (SELECT *, {rate(f'acceleration - lag(acceleration) OVER {W}', jerk)} AS jerk,
         CASE WHEN lead(latitude) OVER {W} IS NOT NULL THEN {bearing('latitude', 'longitude', f'lead(latitude) OVER {W}', f'lead(longitude) OVER {W}')} END AS bearing FROM k4),
k6 AS (SELECT *, abs(bearing - lag(bearing) OVER {W}) AS dd FROM k5),
kin AS (SELECT * EXCLUDE (dd), CASE WHEN coalesce(leg_km, 0) >= {leg} THEN coalesce(CASE WHEN dd IS NULL THEN NULL ELSE least(dd, 360 - dd) END, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS turn_angle FROM k6)"""


SERIES = ("speed_kmh", "acceleration", "turn_angle")


def stats(frame: str, suffix: str = "", null_std: bool = False) -> str:
    """SELECT items."""
    out = []
    for c in SERIES:
        std = f"stddev_samp({c}) OVER {frame}"
        out += [f"avg({c}) OVER {frame} AS {c}_mean{suffix}", (std if null_std else f"coalesce({std}, 0.0)") + f" AS {c}_std{suffix}"]
        out += [] if null_std else [f"max({c}) OVER {frame} AS {c}_max{suffix}", f"min({c}) OVER {frame} AS {c}_min{suffix}"]
    return ", ".join(out)


def time_frame(minutes: float) -> str:
    half = int(minutes * 30e6)
    return f"(PARTITION BY trip_id ORDER BY t_us RANGE BETWEEN {half - 1} PRECEDING AND {half} FOLLOWING)"


def shape(neighbours: str, out: str = "shp") -> str:
    """CTEs from `neighbours` (trip_id, event_id, ord, lat, lon) to `out`: trip_id, event_id, n_near, straightness, radius_gyration_km, sinuosity."""
    w = "(PARTITION BY trip_id, event_id ORDER BY ord)"
    return f"""{out}_1 AS (SELECT *, CASE WHEN lag(lat) OVER {w} IS NOT NULL THEN {hav(f'lag(lat) OVER {w}', f'lag(lon) OVER {w}', 'lat', 'lon')} END AS step, avg(lat) OVER (PARTITION BY trip_id, event_id) AS clat, avg(lon) OVER (PARTITION BY trip_id, event_id) AS clon FROM {neighbours}),
{out}_2 AS (SELECT trip_id, event_id, count(*) AS n_near, coalesce(sum(step), 0.0) AS path, {hav('arg_min(lat, ord)', 'arg_min(lon, ord)', 'arg_max(lat, ord)', 'arg_max(lon, ord)')} AS chord, sqrt(avg(pow({hav('lat', 'lon', 'clat', 'clon')}, 2))) AS rog FROM {out}_1 GROUP BY trip_id, event_id),
{out} AS (SELECT trip_id, event_id, n_near, CASE WHEN n_near < 2 OR path = 0 THEN 1.0::DOUBLE ELSE chord / path END AS straightness, CASE WHEN n_near < 2 THEN 0.0::DOUBLE ELSE rog END AS radius_gyration_km,
  CASE WHEN n_near < 2 OR chord <= 0.001 THEN 1.0::DOUBLE ELSE greatest(1.0::DOUBLE, least(10.0::DOUBLE, path / chord)) END AS sinuosity FROM {out}_2)"""


def row_neighbours(src: str, before: int, after: int) -> str:
    """CTEs `num` and `nb`."""
    return f"""num AS (SELECT *, row_number() OVER {W} AS rn FROM {src}),
nb AS (SELECT a.trip_id, a.event_id, b.rn AS ord, b.latitude AS lat, b.longitude AS lon FROM num a JOIN num b ON a.trip_id = b.trip_id AND b.rn BETWEEN a.rn - {before} AND a.rn + {after})"""


def near_neighbours(src: str, radius: float, planar: bool) -> str:
    far = "sqrt(pow(a.latitude * 111.0 - b.latitude * 111.0, 2) + pow(a.longitude * 111.0 * a.k - b.longitude * 111.0 * b.k, 2))" if planar else hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")
    return f"""num AS (SELECT *, row_number() OVER {W} AS rn, cos(radians(avg(latitude) OVER (PARTITION BY trip_id))) AS k FROM {src}),
nb AS (SELECT a.trip_id, a.event_id, b.rn AS ord, b.latitude AS lat, b.longitude AS lon FROM num a JOIN num b ON a.trip_id = b.trip_id WHERE {far} <= {radius})"""


def flags(suffix: str = "") -> str:
    return f"""coalesce(speed_kmh_mean{suffix} BETWEEN 0.5 AND 8.0, false)::INT AS is_fishing_speed, coalesce(speed_kmh_mean{suffix} >= 12.0, false)::INT AS is_transit_speed, coalesce(turn_angle_mean{suffix} >= 45.0, false)::INT AS is_high_turning,
coalesce(straightness <= 0.4, false)::INT AS is_low_straightness, coalesce(sinuosity >= 1.5, false)::INT AS is_high_sinuosity, coalesce(radius_gyration_km <= 0.5, false)::INT AS is_clustered, coalesce(speed_cv{suffix} >= 0.6, false)::INT AS is_variable_speed"""


BASE_SCORE = "3.0::DOUBLE * is_fishing_speed + 2.0 * is_high_turning + 2.0 * is_low_straightness + 1.5 * is_high_sinuosity + 2.0 * is_clustered + 1.5 * is_variable_speed"


def smoothed(src: str, state: str, least: int, out: str = "smo") -> str:
    """CTEs from src to `out`, whose column `state` is smoothed."""
    return f"""{out}_1 AS (SELECT *, sum(chg) OVER {SO_FAR} AS run FROM (SELECT *, coalesce({state} <> lag({state}) OVER {W}, false)::INT AS chg FROM {src})),
{out}_2 AS (SELECT *, count(*) OVER (PARTITION BY trip_id, run) AS size, max(run) OVER (PARTITION BY trip_id) AS last_run FROM {out}_1),
{out}_3 AS (SELECT *, CASE WHEN run = 0 OR size >= {least} OR (run = 1 AND last_run = 1) THEN {state} WHEN run = 1 THEN 1 - {state} END AS kept FROM {out}_2),
{out} AS (SELECT * EXCLUDE (chg, run, size, last_run, kept, {state}), last_value(kept IGNORE NULLS) OVER {SO_FAR} AS {state} FROM {out}_3)"""


def rules(planar: bool) -> str:
    """CTEs from tracks to `res` with is_fishing, smoothed."""
    return f"""{kinematics()},
tst AS (SELECT *, {stats(time_frame(10))} FROM kin),
{near_neighbours('tst', 1.0, planar)},
{shape('nb')},
fea AS (SELECT tst.*, speed_kmh_std / (speed_kmh_mean + 0.1) AS speed_cv, straightness, radius_gyration_km, sinuosity FROM tst JOIN shp USING (trip_id, event_id)),
fl AS (SELECT *, {flags()} FROM fea),
fl2 AS (SELECT *, is_fishing_speed * is_high_turning * is_clustered AS is_fishing_pattern, coalesce(speed_kmh_mean BETWEEN 2.0 AND 10.0, false)::INT * is_high_turning AS is_search_pattern FROM fl),
sc AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({BASE_SCORE} + 3.0 * is_fishing_pattern + 2.0 * is_search_pattern - 5.0 * is_transit_speed) / 17.0)) AS fishing_score FROM fl2),
ver AS (SELECT *, (fishing_score >= 0.5)::INT AS is_fishing FROM sc),
{smoothed('ver', 'is_fishing', 3, 'res')}"""
