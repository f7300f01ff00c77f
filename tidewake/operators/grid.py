"""Rectangular grids: bounds, cell aggregates, hot spots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import first_of, quantiles


def bounds(df: DataFrame, padding: float = 0.05) -> DataFrame:
    """One row: the points' box, wider by a part of each side."""
    a, b, c, d = (f("latitude" if i < 2 else "longitude") for i, f in enumerate((F.min, F.max, F.min, F.max)))
    return df.agg((a - (b - a) * padding).alias("min_lat"), (b + (b - a) * padding).alias("max_lat"), (c - (d - c) * padding).alias("min_lon"), (d + (d - c) * padding).alias("max_lon"))


def grid(df: DataFrame, size: float = 0.01, how: str = "sum", value: str | None = None) -> DataFrame:
    """i, j, value: points by cell from the padded box's lower left corner.

    how: sum or mean of a column, count of points, or max (from 0 up, so negative values read 0)."""
    x = F.lit(1.0) if value is None else F.col(value)
    made = {"sum": F.sum(x), "mean": F.avg(x), "count": F.count("*").cast("double"), "max": F.greatest(F.max(x), F.lit(0.0))}
    if how not in made:
        raise ValueError(f"how {how!r} is none of {', '.join(made)}")
    box = F.broadcast(bounds(df))  # one row
    at = df.crossJoin(box).select(F.floor((F.col("latitude") - F.col("min_lat")) / size).alias("i"), F.floor((F.col("longitude") - F.col("min_lon")) / size).alias("j"), *([value] if value else []), "min_lat", "min_lon")
    return at.groupBy("i", "j").agg(made[how].cast("double").alias("value"), (F.min("min_lat") + F.col("i") * size).alias("lat"), (F.min("min_lon") + F.col("j") * size).alias("lon"))


def hotspots(cells: DataFrame, percentile: float = 90.0, size: float | None = None) -> DataFrame:
    """Cells whose value is at or over a percentile of the non-zero cells, with it as `threshold`.  lat and lon are lower left corners, or centres if size is given."""
    full = cells.where("value > 0")
    edge = quantiles(full, "value", [percentile / 100]).select(first_of("q").alias("threshold"))
    out = full.crossJoin(F.broadcast(edge)).where(F.col("value") >= F.col("threshold"))  # one row
    return out.withColumn("lat", F.col("lat") + size / 2).withColumn("lon", F.col("lon") + size / 2) if size else out


def grid_stats(cells: DataFrame) -> DataFrame:
    """total, largest cell, 90th percentile of the non-zero cells and how many reach it."""
    full = cells.where("value > 0")
    edge = quantiles(full, "value", [0.9]).select(first_of("q").alias("threshold"))
    sums = [F.sum("value").alias("total"), F.max("value").alias("max_cell"), F.count_if(F.col("value") >= F.col("threshold")).alias("n_hotspots")]
    return full.crossJoin(F.broadcast(edge)).groupBy("threshold").agg(*sums).select("total", "max_cell", "threshold", "n_hotspots")  # one row
