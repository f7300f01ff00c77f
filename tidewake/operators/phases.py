"""Trip phases (start, in progress, end) and activity types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from .kinematics import trip


@dataclass(frozen=True)
class Phases:
    """Distances (km) and parts of the trip that count as its start and end; the class defaults, and those of the function alone."""

    start_km: float = 1.0
    end_km: float = 1.0
    start_part: float = 0.05
    end_part: float = 0.05


ALONE = Phases(2.0, 2.0, 0.15, 0.15)


def phases(points: DataFrame, how: Phases = Phases()) -> DataFrame:
    """dist_to_start_km, dist_to_end_km, trip_progress and trip_phase; trips of fewer than 3 points read 0, 0, 0 and in_progress."""
    whole = trip().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n, i = F.count("*").over(W.partitionBy("trip_id")), F.row_number().over(trip()) - 1
    lat, lon = F.col("latitude"), F.col("longitude")
    at = lambda f: haversine_km(lat, lon, f("latitude").over(whole), f("longitude").over(whole))
    long = F.col("_n") >= 3
    df = points.withColumn("_n", n).withColumn("_i", i)
    df = df.withColumns({"dist_to_start_km": F.when(long, at(F.first)).otherwise(0.0), "dist_to_end_km": F.when(long, at(F.last)).otherwise(0.0), "trip_progress": F.when(long, F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1))).otherwise(0.0)})
    end = (F.col("dist_to_end_km") <= how.end_km) | (F.col("trip_progress") >= 1 - how.end_part)
    start = (F.col("dist_to_start_km") <= how.start_km) | (F.col("trip_progress") <= how.start_part)
    return df.withColumn("trip_phase", F.when(long & end, "ending").when(long & start, "starting").otherwise("in_progress")).withColumn("is_start_phase", F.coalesce(long & start, F.lit(False)).cast("int")).withColumn("is_end_phase", F.coalesce(long & end, F.lit(False)).cast("int")).drop("_n", "_i")


def activity_types(df: DataFrame) -> DataFrame:
    """activity_type: the phase at a trip's ends; in between fishing or sailing."""
    return df.withColumn("activity_type", F.when(F.col("trip_phase") == "starting", "starting_trip").when(F.col("trip_phase") == "ending", "ending_trip").when(F.col("is_fishing") == 1, "fishing").otherwise("sailing"))
