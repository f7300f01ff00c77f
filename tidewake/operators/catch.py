"""Catch and effort statistics over landings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import stars
from ..functions.temporal import landing_season
from ..sources.staging import beside, staged
from .quantiles import SMALL_ROWS, first_of, many_quantiles, quantiles, ranks


def clean(df: DataFrame) -> DataFrame:
    """Labels lower-cased and trimmed, numbers from strings (bad ones NULL), season, year, month, dow (Monday 0)."""
    at = F.col("landing_date")
    label = lambda c: F.lower(F.trim(c))
    df = df.withColumns({"bmu": label("bmu"), "gear": label("gear"), **{c: F.expr(f"try_cast(`{c}` as double)") for c in ("total_fishers", "total_catch_kg", "effort", "cpue")}})
    return df.withColumns({"year": F.year(at), "month": F.month(at), "dow": F.weekday(at), "season": landing_season(F.month(at))})


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_missing, percent."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns], F.count("*").alias("_n")).unpivot(["_n"], columns, "column", "n_missing").select("column", "n_missing", (100 * F.col("n_missing") / F.col("_n")).alias("percent"))


def impute_effort(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Missing effort where fishers are known: fishers over the unit's median of fishers/effort (infinite at effort 0).  effort_imputed marks them.  rows: a count of df, if it is known."""
    area = F.when(F.col("effort") == 0, F.when(F.col("total_fishers") > 0, float("inf"))).otherwise(F.col("total_fishers") / F.when(F.col("effort") != 0, F.col("effort")))
    median = many_quantiles(df.withColumn("_a", area), {"_a": [0.5]}, ["bmu"], rows=rows).select("bmu", first_of("_a").alias("median_area"))
    out = df.join(beside(median), "bmu", "left")
    fill = F.col("effort").isNull() & F.col("total_fishers").isNotNull() & F.col("median_area").isNotNull()
    return out.withColumn("effort_imputed", fill).withColumn("effort", F.when(fill, F.col("total_fishers") / F.when(F.col("median_area") != 0, F.col("median_area"))).otherwise(F.col("effort")))


def valid(df: DataFrame) -> DataFrame:
    return df.where(F.col("effort").isNotNull() & F.col("cpue").isNotNull() & F.col("gear").isNotNull() & F.col("bmu").isNotNull() & (F.col("gear") != "nan"))


def trimmed(df: DataFrame, part: float = 0.99, rows: int | None = None) -> DataFrame:
    """Rows at or under the percentile of both cpue and effort, with log_cpue and log_effort (log1p).  rows: a count of df, or a bound of it, if one is known."""
    edge = many_quantiles(df, {"cpue": [part], "effort": [part]}, rows=rows).first()  # as literals the bounds reach the scan
    out = df.where((F.col("cpue") <= edge.cpue[0]) & (F.col("effort") <= edge.effort[0])) if edge else df.where(F.lit(False))
    return out.withColumn("log_cpue", F.log1p("cpue")).withColumn("log_effort", F.log1p("effort"))


def working_set(landings: DataFrame) -> DataFrame:
    """The cleaned, imputed, valid and trimmed rows, staged when this is called, as every statistic reads them several times."""
    cleaned = staged(clean(landings), "landings-clean")
    n = cleaned.count()
    return staged(trimmed(valid(impute_effort(cleaned, n)), rows=n), "landings")


def valid_set(landings: DataFrame) -> DataFrame:
    return valid(impute_effort(staged(clean(landings), "landings-clean")))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: count, mean, std, min, quartiles (interpolated), max."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "x").where("x is not null")
    out = long.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return out.join(quantiles(long, "x", [0.25, 0.5, 0.75], ["column"]), "column").select("column", "n", "mean", "std", "min", *[first_of("q", i).alias(c) for i, c in enumerate(("q25", "q50", "q75"))], "max")


def spearman(df: DataFrame, x: str = "effort", y: str = "cpue", by: list[str] = (), rows: int | None = None) -> DataFrame:
    """rho and n, over all rows or by group (with_p() adds its p value).  rows: a count of df, if it is known; up to SMALL_ROWS one sort a column ranks them, more are ranked by distinct pairs, with the same result."""
    by = list(by)
    n = rows if rows is not None else df.count()
    if n <= SMALL_ROWS:
        at = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
        for c, r in ((x, "_x"), (y, "_y")):
            order = W.partitionBy(*(by or [F.lit(0)])).orderBy(c)
            at = at.withColumn(r, (F.rank().over(order) + F.count("*").over(order.rangeBetween(W.unboundedPreceding, 0))) / 2)
        return at.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))
    pairs = staged(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("_n")), "pairs")
    at = pairs
    for c, r in ((x, "_x"), (y, "_y")):
        at = at.join(beside(ranks(pairs, c, r, by, weight="_n"), "ranks"), [*by, c])
    total = pairs.groupBy(*by).agg(F.sum("_n").alias("n"))
    at = at.join(beside(total), by) if by else at.crossJoin(F.broadcast(total))  # one row without groups
    dx, dy = (F.col(c) - (F.col("n") + 1) / 2 for c in ("_x", "_y"))  # ranks less their mean
    s = lambda a, b: F.sum(F.col("_n") * a * b)
    spread = F.sqrt(s(dx, dx)) * F.sqrt(s(dy, dy))
    return at.groupBy(*by, "n").agg((s(dx, dy) / F.when(spread > 0, spread)).alias("rho")).select(*by, "rho", "n")


def with_p(df: DataFrame, r: str, n: str, name: str = "p", marks: str | None = None) -> DataFrame:
    """df with the two-sided p value of a correlation r over n pairs by Student's t, and with its significance marks; NULL where r is or n is under 3.

    For a row a test, not for points: p values are worked out one by one."""
    from .regression import correlation_p

    @F.pandas_udf("double")
    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([None if r != r or r is None or n < 3 else correlation_p(float(r), int(n)) for r, n in zip(rs, ns, strict=True)], dtype="float64")

    out = df.withColumn(name, p(F.col(r).cast("double"), F.col(n).cast("double")))
    return out.withColumn(marks, stars(F.col(name))) if marks else out


def gear_subset(df: DataFrame, gears: list[str]) -> DataFrame:
    """Rows of the gears (lower case); a subset without rows is an error."""
    out = df.where(F.col("gear").isin(*[g.lower() for g in gears]))
    if out.isEmpty():
        raise ValueError(f"there are no landings of {', '.join(gears)}")
    return out


def line(x: str, y: str) -> list[Column]:
    """slope, intercept, r of y on x."""
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r")]


def ols(df: DataFrame, x: str = "log_effort", y: str = "log_cpue") -> DataFrame:
    return df.agg(*line(x, y), F.count("*").alias("n"))


def quantile_bins(df: DataFrame, bins: int = 20, by: list[str] = ()) -> DataFrame:
    """Right-closed effort bins between interpolated quantiles, equal edges merged: bin, effort_median, cpue_mean, cpue_se, n."""
    by, n, parts = list(by), df.count(), [i / bins for i in range(bins + 1)]
    edges = many_quantiles(df, {"effort": parts}, by, rows=n).select(*by, F.array_distinct("effort").alias("_edges"))
    if by:
        at = df.join(beside(edges), by)
    else:
        found = edges.first()
        at = df.withColumn("_edges", F.array(*map(F.lit, found[0]))) if found else df.limit(0).withColumn("_edges", F.array().cast("array<double>"))
    first = F.get("_edges", F.lit(0))
    number = F.when(F.col("effort") == first, 1).otherwise(F.size(F.filter("_edges", lambda e: e < F.col("effort"))))
    at = at.withColumn("bin", number.cast("int")).drop("_edges")
    sums = [F.avg("cpue").alias("cpue_mean"), (F.stddev_samp("cpue") / F.sqrt(F.count("*"))).alias("cpue_se"), F.count("*").alias("n")]
    if n <= SMALL_ROWS:  # as quantiles(), in the same pass
        return at.groupBy(*by, "bin").agg(*sums, F.median("effort").alias("effort_median"))
    middle = many_quantiles(at, {"effort": [0.5]}, [*by, "bin"], rows=n).select(*by, "bin", first_of("effort").alias("effort_median"))
    return at.groupBy(*by, "bin").agg(*sums).join(middle, [*by, "bin"])


def means_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("cpue").alias("cpue_mean"), F.avg("effort").alias("effort_mean"), F.count("*").alias("n"))


def monthly_correlation(df: DataFrame) -> DataFrame:
    """Pearson's r of the twelve months' mean cpue and effort."""
    return means_by(df, "month").agg(F.corr("effort_mean", "cpue_mean").alias("r"), F.count("*").alias("n_months"))


def annual_trend(df: DataFrame, first: int = 2000, last: int = 2024) -> DataFrame:
    """Slopes a year of the annual means."""
    years = means_by(df.where(F.col("year").between(first, last)), "year")
    return years.agg(F.regr_slope("cpue_mean", "year").alias("cpue_slope"), F.regr_slope("effort_mean", "year").alias("effort_slope"), F.count("*").alias("n_years"))


def group_stats(df: DataFrame, by: str, least: int = 30) -> DataFrame:
    """Per gear or unit with enough rows: medians and means, effort_cv, rho, depl_ratio (mean cpue over the upper to that under the lower effort quartile), log_slope, cpue_trend (over more than two years), n_years."""
    many = df.groupBy(by, "year").agg(F.count("*").alias("n")).groupBy(by).agg(F.sum("n").alias("n"), F.count("year").alias("n_years")).where(F.col("n") >= least)
    rows = df.count()
    middle = many_quantiles(df, {"effort": [0.25, 0.5, 0.75], "cpue": [0.5]}, [by], rows=rows).select(by, F.col("effort").alias("_q"), first_of("cpue").alias("cpue_med"))
    at = df.join(beside(many.join(middle, by)), by)
    low, high = F.avg(F.when(F.col("effort") <= first_of("_q"), F.col("cpue"))), F.avg(F.when(F.col("effort") >= first_of("_q", 2), F.col("cpue")))
    years = F.col("n_years")  # counted first: a distinct count here would send every row twice
    out = at.groupBy(by, "n", "n_years", "cpue_med", first_of("_q", 1).alias("effort_med")).agg((F.stddev_samp("effort") / F.avg("effort")).alias("effort_cv"), F.avg("cpue").alias("cpue_mean"), F.when(low > 0, high / F.when(low > 0, low)).alias("depl_ratio"), F.regr_slope("log_cpue", "log_effort").alias("log_slope"), F.when(years > 2, F.regr_slope("cpue", "year")).alias("cpue_trend"))
    return out.join(beside(spearman(df, by=[by], rows=rows).select(by, "rho")), by)


def depletion(ratio: Column) -> Column:
    return F.when(ratio < 0.70, "strong").when(ratio <= 0.90, "moderate").when(ratio >= 1.00, "none").otherwise("weak")


def hidden_depletion(stats: DataFrame) -> DataFrame:
    return stats.withColumn("hidden_depletion", F.coalesce((F.col("rho") > 0.1) & (F.col("cpue_trend") < -0.05), F.lit(False)))


def risk(stats: DataFrame) -> DataFrame:
    """risk_score 0 to 3 and its label: negative rho, low depletion ratio, falling cpue."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    s = one(F.col("rho") < -0.15) + one(F.col("depl_ratio") < 0.65) + one(F.col("cpue_trend") < -0.05)
    return stats.withColumn("risk_score", s).withColumn("risk", F.get(F.array(*map(F.lit, ("Low", "Medium", "High", "CRITICAL"))), F.col("risk_score")))


def effort_cv_bands(df: DataFrame) -> DataFrame:
    """Variation of effort within each unit and how feasible fixed effects are with it."""
    out = df.groupBy("bmu").agg((F.stddev_samp("effort") / F.avg("effort")).alias("effort_cv"), F.count("*").alias("n"))
    cv = F.col("effort_cv")
    return out.withColumn("feasibility", F.when(cv < 0.3, "poor").when(cv < 0.5, "fair").when(cv < 0.7, "good").otherwise("excellent"))


def feature_matrix(df: DataFrame, gears: list[str], least: int = 50) -> DataFrame:
    """Units with enough rows: group_stats() figures, each gear's share, gear diversity (Shannon) and the dominant gear; missing figures read the median."""
    stats = group_stats(df, "bmu", least).select("bmu", "n", "effort_cv", "cpue_mean", "cpue_med", "rho", "cpue_trend", "depl_ratio")
    parts = df.groupBy("bmu", "gear").agg(F.count("*").alias("_g"), F.avg("effort").alias("_e")).withColumn("_p", F.col("_g") / F.sum("_g").over(W.partitionBy("bmu")))
    shares = [F.coalesce(F.sum(F.when(F.col("gear") == g, F.col("_p"))), F.lit(0.0)).alias("pct_" + g.replace("-", "_").replace(" ", "_")) for g in gears]
    mix = parts.groupBy("bmu").agg((-F.sum(F.col("_p") * F.log(F.col("_p") + 1e-9))).alias("gear_div"), F.min_by("gear", F.struct(-F.col("_g"), "gear")).alias("dom_gear"), (F.sum(F.col("_e") * F.col("_g")) / F.sum("_g")).alias("effort_mean"), *shares)
    out = stats.join(mix, "bmu")
    holes = [c for c in ("effort_cv", "rho", "cpue_trend", "depl_ratio")]
    medians = out.agg(*[F.median(c).alias(f"_{c}") for c in holes])
    out = out.crossJoin(F.broadcast(medians))  # one row
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in holes}).drop(*[f"_{c}" for c in holes])


def double_demeaned(df: DataFrame) -> DataFrame:
    """x less its unit's and its year's mean, plus the mean: log_cpue_dm, log_effort_dm.  Means come from one aggregate by (unit, year) and are joined back."""
    sums = staged(df.groupBy("bmu", "year").agg(*[F.sum(c).alias(c) for c in ("log_cpue", "log_effort")], F.count("*").alias("_n")), "unit-years")
    mean = lambda *by: sums.groupBy(*by).agg(*[(F.sum(c) / F.sum("_n")).alias(f"_{c}_{'_'.join(by)}") for c in ("log_cpue", "log_effort")])
    out = df.join(beside(mean("bmu")), "bmu").join(beside(mean("year")), "year").crossJoin(F.broadcast(mean()))  # one row
    dm = {f"{c}_dm": F.col(c) - F.col(f"_{c}_bmu") - F.col(f"_{c}_year") + F.col(f"_{c}_") for c in ("log_cpue", "log_effort")}
    return out.withColumns(dm).drop(*[f"_{c}_{b}" for c in ("log_cpue", "log_effort") for b in ("bmu", "year", "")])


def within_fit(df: DataFrame) -> DataFrame:
    """Slope and R² of the double-demeaned variables."""
    return double_demeaned(df).agg(F.regr_slope("log_cpue_dm", "log_effort_dm").alias("beta"), F.pow(F.corr("log_effort_dm", "log_cpue_dm"), 2).alias("within_r2"), F.count("*").alias("n"))


def pre_trends(df: DataFrame, until: int = 2005) -> DataFrame:
    """Slope of each unit's annual mean log_cpue up to a year, with three years or more; r and n for its p value."""
    years = df.where(F.col("year") <= until).groupBy("bmu", "year").agg(F.avg("log_cpue").alias("_m"))
    return years.groupBy("bmu").agg(F.regr_slope("_m", "year").alias("slope"), F.corr("year", "_m").alias("r"), F.count("*").alias("n_years")).where("n_years >= 3")


def parallel_trends(df: DataFrame, until: int = 2005, level: float = 0.05) -> DataFrame:
    """pre_trends() with p and whether it is under the level."""
    return with_p(pre_trends(df, until), "r", "n_years").withColumn("significant", F.coalesce(F.col("p") < level, F.lit(False)))


def trends_verdict(trends: DataFrame, most: int = 3) -> DataFrame:
    """One row over parallel_trends(): units, significant ones, mean slope, and the verdict: supported if few are significant."""
    out = trends.agg(F.count("*").alias("n_units"), F.count_if("significant").alias("n_significant"), F.avg("slope").alias("mean_slope"))
    return out.withColumn("verdict", F.when(F.col("n_significant") <= most, "supported").otherwise("partial concern"))


def normalised_trends(df: DataFrame, base: int = 2000, until: int = 2005) -> DataFrame:
    """bmu, year, log_cpue_norm: each unit's annual mean log_cpue less that of the base year; units without that year are left out."""
    years = df.where(F.col("year") <= until).groupBy("bmu", "year").agg(F.avg("log_cpue").alias("_m"))
    at_base = F.max(F.when(F.col("year") == base, F.col("_m"))).over(W.partitionBy("bmu"))
    return years.withColumn("log_cpue_norm", F.col("_m") - at_base).where("log_cpue_norm is not null").select("bmu", "year", "log_cpue_norm")


def unit_gain(df: DataFrame, beta: float, change: float = -0.3) -> DataFrame:
    """bmu, mean_effort, mean_cpue and cpue_gain: the mean cpue's change, times 100, that an elasticity foresees."""
    out = df.groupBy("bmu").agg(F.avg("effort").alias("mean_effort"), F.avg("cpue").alias("mean_cpue"))
    return out.withColumn("cpue_gain", F.col("mean_cpue") * ((1 + change) ** beta - 1) * 100)


def weighted_line(bins: DataFrame) -> DataFrame:
    """slope, intercept of cpue_mean on effort_median over quantile_bins(), each bin weighted by its rows."""
    n, x, y = F.col("n"), F.col("effort_median"), F.col("cpue_mean")
    s = {k: F.sum(e) for k, e in {"w": n, "x": n * x, "y": n * y, "xx": n * x * x, "xy": n * x * y}.items()}
    slope = (s["w"] * s["xy"] - s["x"] * s["y"]) / F.nullif(s["w"] * s["xx"] - s["x"] * s["x"], F.lit(0.0))
    return bins.agg(slope.alias("slope"), ((s["y"] - slope * s["x"]) / s["w"]).alias("intercept"))


def elasticity(beta: float, low: float, high: float, changes=(-0.5, -0.3, -0.1, 0.1, 0.3, 0.5)) -> list[dict]:
    """Per relative change of effort the relative change of cpue, for an elasticity and its bounds."""
    return [{"change": c, **{n: (1 + c) ** b - 1 for n, b in (("beta", beta), ("low", low), ("high", high))}} for c in changes]


def moments(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.skewness(column).alias("skew"), F.kurtosis(column).alias("excess_kurtosis"))
