"""Streams of GPS points: trips as sessions.  The batch operators stay the reference; smoothing.py smooths states on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trip_sessions(points: DataFrame, vessel: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """One row a trip of a vessel: a session ends after a gap; points later than `late` are left out once it is closed."""
    return points.withWatermark(time, late).groupBy(vessel, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_points")).select(vessel, F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "n_points")
