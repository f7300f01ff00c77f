"""The driver's tables as the engine's inputs: GPS tracks from events, landings from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORIGIN = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip_id, event_id, t_us (microseconds since ORIGIN, time 60 times faster), latitude, longitude, speed, event_type."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    w = W.partitionBy("user_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    walk = lambda k: F.sum(F.col("event_id") * k % 20001 - 10000).over(w)
    us = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{ORIGIN}', ts) div 60")
    return ev.select(F.col("user_id").alias("trip_id"), "event_id", us.alias("t_us"), ((walk(7919) - 6000000) / 1e6).alias("latitude"), ((walk(104729) + 39500000) / 1e6).alias("longitude"), (F.col("value") / 10).alias("speed"), "event_type")


def stamp(t_us="t_us"):
    """The time of t_us as timestamp_ntz."""
    return F.expr(f"timestampadd(MICROSECOND, {t_us}, timestamp_ntz'{ORIGIN}')")


def landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bmu, gear, landing_date, total_fishers, total_catch_kg, effort (some NULL), cpue."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    at = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    fishers, kg = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    return at.select(
        F.lower(F.trim("n_name")).alias("bmu"), F.lower(F.trim("o_orderpriority")).alias("gear"), F.to_date("l_shipdate").alias("landing_date"), fishers.alias("total_fishers"), kg.alias("total_catch_kg"),
        F.when(F.col("l_partkey") % 11 != 0, fishers / (10 + F.col("n_nationkey"))).alias("effort"), (kg / fishers).alias("cpue"), "l_orderkey", "l_linenumber",
    )
