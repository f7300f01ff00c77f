"""Per-trip kinematics by lag and lead: one exchange on the trip, one sort by time, no loop over trips."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import bearing_deg, clip, haversine_km, turn_deg, turn_deg_wrapped
from ..sources.tables import stamp

HOUR_US = 3.6e9


@dataclass(frozen=True)
class Kinematics:
    """How a classifier variant wants its features: limits (None: unlimited) and the least leg for a turn."""

    speed: float | None = 50.0
    acceleration: float | None = 30.0
    jerk: float | None = 100.0
    min_leg_km: float = 0.0
    gaps_only: bool = False  # only steps with time between count for acceleration and jerk


PLAIN, GATED, UNLIMITED = Kinematics(), Kinematics(min_leg_km=0.1), Kinematics(None, None, None, 0.0, True)


def trip(*extra: str) -> W:
    return W.partitionBy("trip_id").orderBy("t_us", "event_id", *extra)


def legs(points: DataFrame) -> DataFrame:
    """leg_km and dt_hours from the point before; NULL on a trip's first point."""
    w = trip()
    lat, lon = F.col("latitude"), F.col("longitude")
    return points.withColumn("leg_km", haversine_km(F.lag(lat).over(w), F.lag(lon).over(w), lat, lon)).withColumn("dt_hours", (F.col("t_us") - F.lag("t_us").over(w)) / HOUR_US)


def _rate(change: Column, dt: Column, limit: float | None, gaps_only: bool) -> Column:
    rate = F.when(dt > 0, change / F.when(dt > 0, dt))
    if not gaps_only and limit is not None:  # a change in no time is as large as it gets
        rate = rate.when(dt == 0, F.signum(change) * limit)
    rate = F.coalesce(rate, F.lit(0.0))
    return rate if limit is None else clip(rate, -limit, limit)


def kinematics(points: DataFrame, how: Kinematics = GATED) -> DataFrame:
    """points (trip_id, event_id, t_us, latitude, longitude) with leg_km, dt_hours, speed_kmh, acceleration, jerk, bearing, turn_angle."""
    w, dt = trip(), F.col("dt_hours")
    speed = F.coalesce(F.when(dt > 0, F.col("leg_km") / F.when(dt > 0, dt)), F.lit(0.0))
    out = legs(points).withColumn("speed_kmh", speed if how.speed is None else clip(speed, 0, how.speed))
    out = out.withColumn("acceleration", _rate(F.col("speed_kmh") - F.lag("speed_kmh").over(w), dt, how.acceleration, how.gaps_only))
    out = out.withColumn("jerk", _rate(F.col("acceleration") - F.lag("acceleration").over(w), dt, how.jerk, how.gaps_only))
    out = out.withColumn("bearing", bearing_deg(F.col("latitude"), F.col("longitude"), F.lead("latitude").over(w), F.lead("longitude").over(w)))
    turn = F.coalesce(turn_deg(F.lag("bearing").over(w), F.col("bearing")), F.lit(0.0))
    return out.withColumn("turn_angle", F.when(F.coalesce(F.col("leg_km"), F.lit(0.0)) >= how.min_leg_km, turn).otherwise(0.0))


def positions(points: DataFrame, from_one: bool = False) -> DataFrame:
    """point_number (from 0, or from 1), total_points, trip_position (their ratio), hour, is_daytime."""
    hour = F.hour(stamp())
    from ..functions.temporal import is_daytime

    out = points.withColumn("point_number", (F.row_number().over(trip()) - (0 if from_one else 1)).cast("long")).withColumn("total_points", F.count("*").over(W.partitionBy("trip_id")))
    return out.withColumn("trip_position", F.col("point_number") / F.col("total_points")).withColumn("hour", hour).withColumn("is_daytime", is_daytime(hour, not from_one))


def time_weights(points: DataFrame, cap_seconds: float = 600.0) -> DataFrame:
    """time_hours: half of each neighbouring gap, either capped, as hours; a missing neighbour adds nothing."""
    w = trip()
    half = lambda gap: F.coalesce(F.least(gap / 1e6, F.lit(cap_seconds)), F.lit(0.0)) / 2
    before, after = F.col("t_us") - F.lag("t_us").over(w), F.lead("t_us").over(w) - F.col("t_us")
    return points.withColumn("time_hours", (F.when(before.isNotNull(), half(before)).otherwise(0.0) + F.when(after.isNotNull(), half(after)).otherwise(0.0)) / 3600)


def cadence(points: DataFrame, local_minutes: float = 0.2, shape_minutes: float = 1.0, least: int = 3, most: int = 25) -> DataFrame:
    """A trip's median whole seconds between points (positive gaps only, 60 without any) and row windows of the two spans, least to most rows."""
    t_s = F.floor(F.col("t_us") / 1e6)
    gaps = points.withColumn("gap", t_s - F.lag(t_s).over(trip()))
    out = gaps.groupBy("trip_id").agg(F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(60.0)).alias("cadence_s"))
    rows = lambda span: F.greatest(F.lit(least), F.least(F.lit(most), F.bround(span * 60 / F.col("cadence_s")).cast("int")))
    return out.select("trip_id", "cadence_s", rows(local_minutes).alias("local_rows"), rows(shape_minutes).alias("shape_rows"))


def activity_runs(points: DataFrame, state: str = "event_type") -> DataFrame:
    """Maximal runs of one state within a trip that have more than one point: run, state, n_points, path_km, from_us, to_us."""
    w = trip()
    change = F.coalesce((~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int"), F.lit(1))
    runs = legs(points).withColumn("run", F.sum(F.when(F.row_number().over(w) == 1, 0).otherwise(change)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    first = F.row_number().over(W.partitionBy("trip_id", "run").orderBy("t_us", "event_id")) == 1
    inner = F.when(first, F.lit(0.0)).otherwise(F.col("leg_km"))
    return runs.withColumn("inner", inner).groupBy("trip_id", "run").agg(F.min(state).alias("state"), F.count("*").alias("n_points"), F.sum("inner").alias("path_km"), F.min("t_us").alias("from_us"), F.max("t_us").alias("to_us")).where("n_points > 1")


def every_kth(points: DataFrame, k: int = 10) -> DataFrame:
    """Direction marks: every k-th point of a trip with the planar direction to the next point."""
    from ..functions.geo import arrow_deg

    w = trip()
    at = points.withColumn("nth", (F.row_number().over(w) - 1).cast("long")).withColumn("arrow", arrow_deg(F.lead("latitude").over(w) - F.col("latitude"), F.lead("longitude").over(w) - F.col("longitude")))
    return at.where((F.col("nth") % k == 0) & F.col("arrow").isNotNull())


def learned_features(points: DataFrame, window: int = 5, speed_clip: float = 60.0, accel_clip: float = 30.0) -> DataFrame:
    """The supervised models' features.  Rolling statistics see unfilled and unlimited rates; then gaps read 0 and rates are limited."""
    from .rolling import shape, window_stats

    w, dt = trip(), F.col("dt_hours")
    rate = lambda x: F.when(dt > 0, x / F.when(dt > 0, dt))
    out = legs(points).withColumn("speed_kmh", rate(F.col("leg_km")))
    out = out.withColumn("acceleration", rate(F.col("speed_kmh") - F.lag("speed_kmh").over(w)))
    out = out.withColumn("jerk", rate(F.col("acceleration") - F.lag("acceleration").over(w)))
    out = out.withColumn("bearing", bearing_deg(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude")))
    out = out.withColumn("turn_angle", turn_deg_wrapped(F.lag("bearing").over(w), F.col("bearing")))
    out = window_stats(out, ["speed_kmh", "acceleration", "turn_angle"], window)
    near = w.rowsBetween(-(window // 2), (window - 1) // 2)
    out = out.withColumn("lat_std_w", F.stddev_samp("latitude").over(near)).withColumn("lon_std_w", F.stddev_samp("longitude").over(near))
    out = shape(out, window // 2, window // 2, names=("straightness_w", "rog_w", None))
    return _context(out, speed_clip, accel_clip)


def device_features(points: DataFrame, altitude: str = "altitude", model: str = "device_model") -> DataFrame:
    """altitude with its median over all points where it is missing, device_model ('Unknown' where missing) and model_enc, its code; without the columns 0 and code 0."""
    from .columns import label_codes
    from .quantiles import first_of, quantiles

    if altitude in points.columns:
        middle = quantiles(points, altitude, [0.5]).select(first_of("q").alias("_middle"))
        points = points.join(F.broadcast(middle), how="left").withColumn("altitude", F.coalesce(F.col(altitude).cast("double"), "_middle", F.lit(0.0))).drop("_middle")  # one row or none
    else:
        points = points.withColumn("altitude", F.lit(0.0))
    if model not in points.columns:
        return points.withColumn("device_model", F.lit("Unknown")).withColumn("model_enc", F.lit(0).cast("long"))
    return label_codes(points.withColumn("device_model", F.coalesce(F.col(model).cast("string"), F.lit("Unknown"))), "device_model", "model_enc")


def _quartile(values: Column, part: float) -> Column:
    """Interpolated quantile of an array's values."""
    s = F.array_sort(values)
    at = part * (F.size(values) - 1)
    low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
    return F.when(F.size(values) > 0, low + (high - low) * (at - F.floor(at)))


def adaptive_features(points: DataFrame, local_minutes: float = 0.2, shape_minutes: float = 1.0, speed_clip: float = 60.0, accel_clip: float = 30.0, most: int = 25) -> DataFrame:
    """The supervised features in windows that follow each trip's cadence: cadence_s, local_rows and shape_rows, then the
    columns of learned_features().  Turns are between the directions to and from a point; rates over no time are 0."""
    from ..sources.staging import beside
    from .rolling import _shaped

    w, dt = trip(), F.col("dt_hours")
    rate = lambda x: F.when(dt > 0, x / F.when(dt > 0, dt))
    out = legs(points).withColumn("speed_kmh", rate(F.col("leg_km")))
    out = out.withColumn("acceleration", rate(F.col("speed_kmh") - F.lag("speed_kmh").over(w)))
    out = out.withColumn("jerk", rate(F.col("acceleration") - F.lag("acceleration").over(w)))
    out = out.withColumn("bearing", bearing_deg(F.col("latitude"), F.col("longitude"), F.lead("latitude").over(w), F.lead("longitude").over(w)))
    out = out.withColumn("turn_angle", turn_deg_wrapped(F.lag("bearing").over(w), F.col("bearing")))
    sizes = cadence(points, local_minutes, shape_minutes, most=most).withColumnRenamed("trip_id", "_trip")
    out = out.join(beside(sizes, "cadence"), F.col("trip_id").eqNullSafe(F.col("_trip"))).drop("_trip").withColumn("_nth", F.row_number().over(w))
    series = ("speed_kmh", "acceleration", "turn_angle")
    around = F.collect_list(F.struct("_nth", *series, F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))).over(w.rowsBetween(-(most // 2), most // 2))
    out = out.withColumn("_around", around)
    within = lambda before, after: F.filter("_around", lambda s: (s["_nth"] >= F.col("_nth") - before) & (s["_nth"] <= F.col("_nth") + after))
    half = lambda c: F.floor(F.col(c) / 2)
    out = out.withColumn("_near", within(half("local_rows"), F.floor((F.col("local_rows") - 1) / 2))).withColumn("_frame", within(half("shape_rows"), half("shape_rows")))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    for c, name in ((*((c, c) for c in series), ("lat", "lat"), ("lon", "lon"))):
        out = out.withColumn("_v", F.filter(F.col("_near")[c], lambda v: v.isNotNull()))
        n = F.size("_v")
        out = out.withColumn("_m", total(F.col("_v")) / F.when(n > 0, n))
        spread = F.aggregate("_v", F.lit(0.0), lambda a, v: a + (v - F.col("_m")) * (v - F.col("_m")))
        made = {f"{name}_std_w": F.when(n > 1, F.sqrt(spread / F.when(n > 1, n - 1)))}
        if c in series:
            made |= {f"{name}_mean_w": F.col("_m"), f"{name}_q25_w": _quartile(F.col("_v"), 0.25), f"{name}_q75_w": _quartile(F.col("_v"), 0.75)}
        out = out.withColumns(made)
    out = _shaped(out, "_frame", ("straightness_w", "rog_w", None)).drop("_around", "_near", "_frame", "_v", "_m", "_nth")
    return _context(out, speed_clip, accel_clip)


def _context(out: DataFrame, speed_clip: float, accel_clip: float) -> DataFrame:
    """What the supervised features have besides windows; then gaps read 0 and rates are limited."""
    w = trip()
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = lambda c: F.first(c, ignorenulls=True).over(whole)
    out = out.withColumn("dist_to_start_km", haversine_km(F.col("latitude"), F.col("longitude"), first("latitude"), first("longitude")))
    out = out.withColumn("trip_pos_norm", (F.row_number().over(w) - 1) / F.count("*").over(W.partitionBy("trip_id"))).withColumn("time_since_start_min", (F.col("t_us") - F.min("t_us").over(W.partitionBy("trip_id"))) / 6e7)
    out = out.withColumn("hour", F.hour(stamp())).withColumn("dayofweek", F.weekday(stamp())).withColumn("is_stationary", F.coalesce(F.col("speed_kmh_mean_w") < 2, F.lit(False)).cast("int"))
    for c, limit in (("speed_kmh", speed_clip), ("acceleration", accel_clip), ("jerk", 3 * accel_clip)):
        out = out.withColumn(c, clip(F.coalesce(c, F.lit(0.0)), 0 if c == "speed_kmh" else -limit, limit))
    return out.na.fill(0.0, [c for c, t in out.dtypes if t == "double"])
