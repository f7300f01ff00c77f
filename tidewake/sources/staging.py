"""Intermediate tables that several passes read: written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and Spark runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not where and context.getCheckpointDir().isDefined():
        where = context.getCheckpointDir().get()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tidewake-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidewake-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage is cut, columns are pruned, and a lost executor loses nothing.

    Plans made of it need the table until they have run; release() removes an application's tables, and so does its end."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if spark.sparkContext.applicationId not in _known:
        _known.add(spark.sparkContext.applicationId)
        atexit.register(_release_quietly, spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


_known: set[str] = set()


def drop_staged(df: DataFrame) -> None:
    """Removes the table of a DataFrame that staged() returned, when nothing that is still to run reads it."""
    _delete(df.sparkSession, df._staged_path)


def release(spark: SparkSession) -> None:
    """Removes all tables that this application has staged; their queries must be done."""
    _delete(spark, _folder(spark))


def _release_quietly(spark: SparkSession) -> None:
    import contextlib

    with contextlib.suppress(Exception):  # the application is over; a stopped session can't delete any more
        if spark.sparkContext._jsc is not None:
            release(spark)


#: Rows of a counted table that may be broadcast.
FEW_ROWS = 200_000


def beside(df: DataFrame, name: str = "groups") -> DataFrame:
    """A table of groups to join to many rows: written and counted, and broadcast if it has FEW_ROWS at most, so that the many rows aren't dealt out by a few group keys."""
    from pyspark.sql import functions as F

    kept = staged(df, name)
    return F.broadcast(kept) if kept.count() <= FEW_ROWS else kept
