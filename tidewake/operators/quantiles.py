"""Exact order statistics without gathering a column in one task.

Spark's exact percentile keeps all distinct values of a group in one task.  Here the rows of each different value are counted
first (copies are summed up where they lie), the values are dealt out by range, and running counts within ranges and over
them say where each value stands.  Quantiles look only into the ranges that hold them: a column is read once, however many
quantiles of it are wanted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import beside, staged

#: Different values in a range: so many are put in order by one task.
FEW = 200_000
#: Up to so many rows, counted first, one task can hold all values: the direct way is quicker and gives the same.
SMALL_ROWS = 2_000_000


def quantiles(df: DataFrame, column: str, probabilities: list[float], by: list[str] = (), small_rows: int = SMALL_ROWS, few: int = FEW) -> DataFrame:
    """by, q: the interpolated quantiles of the non-NULL values, in the order of the probabilities.  Groups without a value are left out.  df is counted, then read once."""
    return many_quantiles(df, {column: probabilities}, by, small_rows, few).withColumnRenamed(column, "q")


def many_quantiles(df: DataFrame, wanted: dict[str, list[float]], by: list[str] = (), small_rows: int = SMALL_ROWS, few: int = FEW, rows: int | None = None) -> DataFrame:
    """by, and for each column its quantiles, as quantiles(); groups that lack values in one column lack them in all.  rows: a count of df, if it is known."""
    by = list(by)
    x = df.select(*by, *[F.col(c).cast("double").alias(c) for c in wanted])
    n = rows if rows is not None else x.count() if small_rows > 0 else 0
    if 0 < n <= small_rows:
        out = x.groupBy(*by).agg(*[F.percentile(c, F.array(*map(F.lit, p))).alias(c) for c, p in wanted.items()])
        return out.where(" and ".join(f"`{c}` is not null" for c in wanted))
    parts = [_placed(x.select(*by, F.col(c).alias("_x")).where("_x is not null"), p, by, few).withColumn("_column", F.lit(j)) for j, (c, p) in enumerate(wanted.items())]
    long = reduce(DataFrame.unionByName, parts)
    sorted_ = lambda j: F.array_sort(F.collect_list(F.when(F.col("_column") == j, F.struct("_i", "q"))))["q"]
    out = long.groupBy(*by).agg(*[sorted_(j).alias(c) for j, c in enumerate(wanted)])
    return out.where(" and ".join(f"size(`{c}`) > 0" for c in wanted))


def _ranges(values: DataFrame, column: str, by: list[str], few: int) -> tuple[DataFrame, DataFrame]:
    """values (by, column, _c rows each) with the _range that they are dealt to; and for each group and range, by names with
    _by_ before them: _at (the range), _in (rows in it), _before (rows in those before) and _all (rows of the group)."""
    n = values.count()
    if n <= few:
        values = values.withColumn("_range", F.lit(0))
    else:
        dealt = values.repartitionByRange(-(-n // few), *by, column)
        values = staged(dealt.withColumn("_range", F.spark_partition_id()), "ranked")  # written, so that ranges stay as they are
    sums = values.groupBy(*by, "_range").agg(F.sum("_c").alias("_in"))
    group = W.partitionBy(*(by or [F.lit(0)]))
    before = (F.sum("_in").over(group.orderBy("_range")) - F.col("_in")).alias("_before")
    return values, beside(sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"), "_in", before, F.sum("_in").over(group).alias("_all")), "ranges")


def _upto(values: DataFrame, ranges: DataFrame, column: str, by: list[str]) -> DataFrame:
    """values of some ranges with _upto, the rows of the group at or under the value, and _all."""
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    within = F.sum("_c").over(W.partitionBy(*by, "_range").orderBy(column).rowsBetween(W.unboundedPreceding, 0))
    return values.join(ranges, same).withColumn("_upto", F.col("_before") + within)


def _placed(x: DataFrame, probabilities: list[float], by: list[str], few: int) -> DataFrame:
    """by, _i, q: the i-th quantile of _x."""
    counts = staged(x.groupBy(*by, "_x").agg(F.count("*").alias("_c")), "values")
    values, ranges = _ranges(counts, "_x", by, few)
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities)])
    place = lambda e: e["p"] * (F.col("_all") - 1)
    within = lambda k, low, high: (k >= low) & (k < high)
    either = lambda low, high: lambda e: within(F.floor(place(e)), low, high) | within(F.ceil(place(e)), low, high)
    ranges = ranges.where(F.exists(each, either(F.col("_before"), F.col("_before") + F.col("_in"))))
    at = _upto(values, ranges, "_x", by)
    low, high = F.col("_upto") - F.col("_c"), F.col("_upto")
    # a range's own few places are met by its values: looking for all places at every value costs their product
    wanted = ranges.select(*[F.col(f"_by_{c}").alias(f"_for_{c}") for c in by], F.col("_at").alias("_in_range"), F.explode(F.filter(each, either(F.col("_before"), F.col("_before") + F.col("_in")))).alias("_e"))
    met = (F.col("_range") == F.col("_in_range")) & either(low, high)(F.col("_e"))
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"_for_{c}"))
    at = at.join(wanted, met).withColumn("_r", place(F.col("_e")))
    value = lambda k: F.min(F.when(within(k, low, high), F.col("_x")))
    out = at.groupBy(*by, F.col("_e.i").alias("_i")).agg(value(F.floor("_r")).alias("a"), value(F.ceil("_r")).alias("b"), F.max(F.col("_r") - F.floor("_r")).alias("f"))
    q = F.when((F.col("f") == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("f"))  # infinite values have no difference
    return out.select(*by, "_i", q.alias("q"))


def ranks(df: DataFrame, column: str, name: str, by: list[str] = (), small_rows: int = SMALL_ROWS, few: int = FEW, weight: str | None = None) -> DataFrame:
    """by, column, name: the average rank of each distinct value in its group, rows counting `weight` times.  Distinct values are dealt out by range, and summed up within ranges and over them."""
    by = list(by)
    values = df.groupBy(*by, column).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    mean = lambda upto: (upto - F.col("_c") + (F.col("_c") + 1) / 2).alias(name)
    if small_rows > 0 and 0 < (n := df.count()) <= small_rows:  # of rows, so of values
        return values.select(*by, column, mean(F.sum("_c").over(W.partitionBy(*(by or [F.lit(0)])).orderBy(column))))
    values, ranges = _ranges(staged(values, "values"), column, by, few)
    return _upto(values, ranges, column, by).select(*by, column, mean(F.col("_upto")))


def average_ranks(df: DataFrame, column: str, name: str, by: list[str] = (), small_rows: int = SMALL_ROWS, few: int = FEW) -> DataFrame:
    """df with each value's average rank in its group; the ranks are written first, so that a value of very many rows is split between tasks."""
    by = list(by)
    found = staged(ranks(df, column, name, by, small_rows, few), "ranks")
    return df.join(found, [*by, column])


def first_of(q: Column | str, i: int = 0) -> Column:
    return F.get(q, F.lit(i))
