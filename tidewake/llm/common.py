"""What several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staged as stored  # noqa: F401

#: Words are runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draw52(*parts: Column | str) -> Column:
    """52 bits of the md5 of the parts joined by '|', as a long; a null part reads 'null'."""
    cells = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cells).cast("binary")), 1, 13), 16, 10).cast("long")


def inline_rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A DataFrame of a few driver-side rows, held in the plan as JSON; only for rows of a bounded number."""
    import json

    at = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")).alias("r"))
    return at.select("r.*")


def boxed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs as `row` (all columns but the text, whatever their names) and `text`; unboxed() turns it back."""
    from pyspark.sql import types as T

    rest = [c for c in docs.columns if c != text_col]
    mark = "_" * (1 + max(map(len, docs.columns)))
    text = docs[text_col] if isinstance(docs.schema[text_col].dataType, T.StringType) else docs[text_col].cast("string")
    return docs.select(F.struct(F.lit(True).alias(mark), *[docs[c] for c in rest]).alias("row"), text.alias("text"))


def unboxed(df: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    return df.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns])


#: Rows of a small side that may be broadcast.
SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; the join is shuffled else."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df
