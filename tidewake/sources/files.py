"""Reading and writing by suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Parquet, CSV (with a header; a byte order mark is dropped) or JSON lines by the path's suffix; another suffix is an error."""
    low = path.lower()
    if low.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if low.endswith((".csv", ".csv.gz")):
        df = spark.read.option("header", True).option("inferSchema", True).option("sep", sep).csv(path)
        return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})
    if low.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    raise ValueError(f"can't tell the format of {path!r}: use .parquet, .csv or .json")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet or CSV by the path's suffix; Spark makes a folder of that name and its parents."""
    low = path.lower()
    if low.endswith((".parquet", ".pq")):
        df.write.mode(mode).parquet(path)
    elif low.endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"can't tell the format of {path!r}: use .parquet or .csv")
