"""Smoothing of states: short runs take the state of the run before them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kinematics import trip


def smooth(df: DataFrame, state: str = "is_fishing", least: int = 3) -> DataFrame:
    """`state` (0 or 1) after smoothing, in closed form over runs 0..K of a trip.

    Run 0 keeps its state.  Run 1 keeps it if it is long enough or the last, else it turns to run 0's.  Every later run
    keeps its state if it is long enough and else takes that of the nearest run before it that kept one."""
    if least <= 1:
        return df
    w = trip()
    change = F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(0))
    df = df.withColumn("_run", F.sum(change).over(w.rowsBetween(W.unboundedPreceding, 0)))
    size = F.count("*").over(W.partitionBy("trip_id", "_run"))
    df = df.withColumn("_size", size).withColumn("_last", F.max("_run").over(W.partitionBy("trip_id")))
    long = F.col("_size") >= least
    kept = F.when((F.col("_run") == 0) | long | ((F.col("_run") == 1) & (F.col("_last") == 1)), F.col(state)).when(F.col("_run") == 1, 1 - F.col(state))
    return df.withColumn("_kept", kept).withColumn(state, F.last("_kept", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_run", "_size", "_last", "_kept")
