"""Aggregates by trip and over layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..sources.tables import stamp
from .kinematics import legs


def trip_summary(df: DataFrame) -> DataFrame:
    """One row a trip over classified points; ratios, scores and speeds are rounded to 4 digits."""
    r = lambda c: F.round(c, 4)
    out = df.groupBy("trip_id").agg(F.count("is_fishing").alias("total_points"), F.sum("is_fishing").alias("fishing_points"), r(F.avg("is_fishing")).alias("fishing_ratio"), r(F.avg("fishing_score")).alias("avg_fishing_score"), r(F.stddev_samp("fishing_score")).alias("std_fishing_score"), r(F.avg("speed_kmh")).alias("avg_speed_kmh"), r(F.max("speed_kmh")).alias("max_speed_kmh"), F.min("t_us").alias("_a"), F.max("t_us").alias("_b"))
    return out.select("*", stamp("_a").alias("start_time"), stamp("_b").alias("end_time"), ((F.col("_b") - F.col("_a")) / 3.6e9).alias("duration_hours")).drop("_a", "_b")


def kinematics_summary(df: DataFrame) -> DataFrame:
    """One row a trip over kinematics: points, path, mean and largest speed, mean turn, hours."""
    return df.groupBy("trip_id").agg(F.count("*").alias("n_points"), F.sum("leg_km").alias("path_km"), F.avg("speed_kmh").alias("avg_speed_kmh"), F.max("speed_kmh").alias("max_speed_kmh"), F.avg("turn_angle").alias("avg_turn"), ((F.max("t_us") - F.min("t_us")) / 3.6e9).alias("duration_hours"))


def trip_statistics(df: DataFrame, effort: str = "is_fishing", speed: str = "speed") -> DataFrame:
    """Counts, times, conditional mean speeds, path and displacement of each trip."""
    at = F.struct("t_us", "event_id")
    point = F.struct("latitude", "longitude")
    fishing, other = F.col(effort) == 1, F.col(effort) == 0
    out = legs(df).groupBy("trip_id").agg(
        F.count("*").alias("total_points"), F.count_if(fishing).alias("fishing_points"), F.count_if(other).alias("non_fishing_points"), (100 * F.count_if(fishing) / F.count("*")).alias("fishing_percentage"), ((F.max("t_us") - F.min("t_us")) / 3.6e9).alias("duration_hours"),
        F.avg(speed).alias("avg_speed"), F.max(speed).alias("max_speed"), F.avg(F.when(fishing, F.col(speed))).alias("avg_fishing_speed"), F.avg(F.when(other, F.col(speed))).alias("avg_transit_speed"), F.coalesce(F.sum("leg_km"), F.lit(0.0)).alias("total_distance_km"), F.min_by(point, at).alias("_a"), F.max_by(point, at).alias("_b"),
    )
    return out.withColumn("displacement_km", haversine_km(F.col("_a.latitude"), F.col("_a.longitude"), F.col("_b.latitude"), F.col("_b.longitude"))).drop("_a", "_b")


def shares(df: DataFrame, column: str) -> DataFrame:
    """How often each value of a column occurs, in counts and percent."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))


def starts_in_box(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """All points of the trips whose first point lies in (min_lat, max_lat, min_lon, max_lon)."""
    first = df.groupBy("trip_id").agg(F.min_by(F.struct("latitude", "longitude"), F.struct("t_us", "event_id")).alias("p"))
    inside = first.where(F.col("p.latitude").between(box[0], box[1]) & F.col("p.longitude").between(box[2], box[3]))
    return df.join(inside.select("trip_id"), "trip_id", "left_semi")


def one_trip(df: DataFrame, trip_id) -> DataFrame:
    """The points of one trip; a trip that isn't there is an error."""
    out = df.where(F.col("trip_id") == trip_id)
    if out.isEmpty():
        raise ValueError(f"there is no trip {trip_id!r}")
    return out


def predicted_summary(df: DataFrame, effort: str = "effort_pred") -> DataFrame:
    """A row for each trip of predicted points: points, fishing points and their ratio, the most fishing first."""
    out = df.groupBy("trip_id").agg(F.count("*").alias("total_points"), F.sum(effort).cast("long").alias("fishing_points"), F.avg(effort).alias("fishing_ratio"))
    return out.orderBy(F.desc("fishing_ratio"), "trip_id")


def coverage(df: DataFrame) -> DataFrame:
    """Annotations of a layer: points, fishing points and share, trips, and distinct latitudes times longitudes."""
    return df.agg(F.count("*").alias("n_points"), F.sum("is_fishing").cast("long").alias("fishing_points"), (100 * F.avg("is_fishing")).alias("fishing_percent"), F.count_distinct("trip_id").alias("n_trips"), (F.count_distinct("latitude") * F.count_distinct("longitude")).alias("coverage"))
