"""Calendar classes: two season maps, day and night, trip time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_START, DAY_END = 6, 18


def monsoon(month: Column) -> Column:
    """Northeast November to March, southeast May to September, between in April and October; NULL without a month."""
    return F.when(month.isin(11, 12, 1, 2, 3), "NE_Monsoon").when(month.isin(4, 10), "Inter_Monsoon").when(month.between(5, 9), "SE_Monsoon")


def landing_season(month: Column) -> Column:
    """March to May, October to December, June to September; all else, NULL too, is the northeast monsoon."""
    return F.when(month.between(3, 5), "Long Rains (MAM)").when(month.between(10, 12), "Short Rains (OND)").when(month.between(6, 9), "SE Monsoon (JJAS)").otherwise("NE Monsoon (JF)")


def day_night(hour: Column) -> Column:
    return F.when((hour >= DAY_START) & (hour < DAY_END), "day").otherwise("night")


def is_daytime(hour: Column, end_included: bool) -> Column:
    return F.coalesce((hour >= DAY_START) & ((hour <= DAY_END) if end_included else (hour < DAY_END)), F.lit(False)).cast("int")


def duration_parts(seconds: Column) -> list[Column]:
    whole = F.floor(seconds).cast("long")
    return [F.floor(whole / 86400).cast("long").alias("days"), F.floor((whole % 86400) / 3600).cast("long").alias("hours"), F.floor((whole % 3600) / 60).cast("long").alias("minutes")]
