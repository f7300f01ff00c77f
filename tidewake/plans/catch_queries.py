"""Registered queries over landings, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catch as C
from ..operators import regression, som
from ..operators.absorbed import fit_absorbed
from ..operators.quantiles import many_quantiles
from ..sources.staging import staged
from ..sources.tables import landings
from .track_queries import r6, sql6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LANDINGS = """landings AS (
  SELECT lower(trim(n_name)) AS bmu, lower(trim(o_orderpriority)) AS gear, l_shipdate::DATE AS landing_date, l_quantity AS total_fishers, l_extendedprice / 1000 AS total_catch_kg,
         CASE WHEN l_partkey % 11 <> 0 THEN l_quantity / (10 + n_nationkey) END AS effort, l_extendedprice / 1000 / l_quantity AS cpue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
cl AS (SELECT *, year(landing_date)::INT AS year, month(landing_date)::INT AS month, CASE WHEN month(landing_date) BETWEEN 3 AND 5 THEN 'Long Rains (MAM)' WHEN month(landing_date) BETWEEN 10 AND 12 THEN 'Short Rains (OND)' WHEN month(landing_date) BETWEEN 6 AND 9 THEN 'SE Monsoon (JJAS)' ELSE 'NE Monsoon (JF)' END AS season FROM landings),
md AS (SELECT bmu, median(total_fishers / effort) AS median_area FROM cl GROUP BY bmu),
im AS (SELECT cl.* EXCLUDE (effort), cl.effort IS NULL AND total_fishers IS NOT NULL AND median_area IS NOT NULL AS effort_imputed, coalesce(effort, total_fishers / median_area) AS effort FROM cl LEFT JOIN md USING (bmu)),
va AS (SELECT * FROM im WHERE effort IS NOT NULL AND cpue IS NOT NULL AND gear IS NOT NULL AND bmu IS NOT NULL),
ed AS (SELECT quantile_cont(cpue, 0.99) AS qc, quantile_cont(effort, 0.99) AS qe FROM va),
ws AS (SELECT va.*, ln(1 + cpue) AS log_cpue, ln(1 + effort) AS log_effort FROM va, ed WHERE cpue <= qc AND effort <= qe)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(landings(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {LANDINGS} {sql}" if not sql.startswith(",") else f"WITH RECURSIVE {LANDINGS}{sql}"
        return f

    return add


def ranks(x: str, by: str = "") -> str:
    p = f"PARTITION BY {by} " if by else ""
    q = f"PARTITION BY {by}, {x}" if by else f"PARTITION BY {x}"
    return f"rank() OVER ({p}ORDER BY {x}) + (count(*) OVER ({q}) - 1) / 2"


@query("SELECT season, year, month, count(*) AS n, round(sum(cpue), 4) AS cpue_sum FROM cl GROUP BY ALL")
def landing_calendar(l):
    return C.clean(l).groupBy("season", "year", "month").agg(F.count("*").alias("n"), F.round(F.sum("cpue"), 4).alias("cpue_sum"))


@query("SELECT 'effort' AS \"column\", count(*) FILTER (effort IS NULL) AS n_missing, round(100 * count(*) FILTER (effort IS NULL) / count(*), 6) AS percent FROM cl UNION ALL SELECT 'cpue', count(*) FILTER (cpue IS NULL), round(100 * count(*) FILTER (cpue IS NULL) / count(*), 6) FROM cl UNION ALL SELECT 'gear', count(*) FILTER (gear IS NULL), round(100 * count(*) FILTER (gear IS NULL) / count(*), 6) FROM cl")
def missing_profile(l):
    return r6(C.missing(C.clean(l), ["effort", "cpue", "gear"]))


@query("SELECT bmu, count(*) AS n, count(*) FILTER (effort_imputed) AS n_imputed, round(avg(effort), 6) AS effort_mean, round(sum(effort) FILTER (effort_imputed), 4) AS imputed_sum FROM im GROUP BY bmu")
def effort_imputation(l):
    return C.impute_effort(staged(C.clean(l), "landings-clean")).groupBy("bmu").agg(F.count("*").alias("n"), F.count_if("effort_imputed").alias("n_imputed"), F.round(F.avg("effort"), 6).alias("effort_mean"), F.round(F.sum(F.when(F.col("effort_imputed"), F.col("effort"))), 4).alias("imputed_sum"))


@query("SELECT bmu, gear, count(*) AS n, round(max(cpue), 6) AS cpue_max, round(max(effort), 6) AS effort_max, round(avg(log_cpue), 6) AS log_cpue_mean FROM ws GROUP BY bmu, gear")
def trimmed_set(l):
    return r6(C.working_set(l).groupBy("bmu", "gear").agg(F.count("*").alias("n"), F.max("cpue").alias("cpue_max"), F.max("effort").alias("effort_max"), F.avg("log_cpue").alias("log_cpue_mean")))


_DESCRIBE = "SELECT '{0}' AS \"column\", count({0}) AS n, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, round(min({0}), 6) AS min, round(quantile_cont({0}, 0.25), 6) AS q25, round(quantile_cont({0}, 0.5), 6) AS q50, round(quantile_cont({0}, 0.75), 6) AS q75, round(max({0}), 6) AS max FROM ws"


@query(" UNION ALL ".join(_DESCRIBE.format(c) for c in ("effort", "cpue", "total_catch_kg")))
def describe_landings(l):
    return r6(C.describe(C.working_set(l), ["effort", "cpue", "total_catch_kg"]))


@query(f", r AS (SELECT {ranks('effort')} AS x, {ranks('cpue')} AS y FROM ws) SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM r")
def spearman_effort_cpue(l):
    return r6(C.spearman(C.working_set(l)))


@query("SELECT round(regr_slope(log_cpue, log_effort), 6) AS slope, round(regr_intercept(log_cpue, log_effort), 6) AS intercept, round(corr(log_effort, log_cpue), 6) AS r, count(*) AS n FROM ws")
def log_log_line(l):
    return r6(C.ols(C.working_set(l)))


def _bins(n: int, by: str = "") -> str:
    group, on = (f"GROUP BY {by}", f"USING ({by})") if by else ("", "")
    join = f"JOIN e {on}" if by else ", e"
    return f""", e AS (SELECT {by + ',' if by else ''} list_distinct(quantile_cont(effort, [{", ".join(repr(i / n) for i in range(n + 1))}])) AS edges FROM ws {group}),
b AS (SELECT ws.*, CASE WHEN effort = list_min(edges) THEN 1 ELSE len(list_filter(edges, lambda v: v < effort)) END::INT AS bin FROM ws {join})
SELECT {by + ',' if by else ''} bin, round(median(effort), 6) AS effort_median, round(avg(cpue), 6) AS cpue_mean, round(stddev_samp(cpue) / sqrt(count(*)), 6) AS cpue_se, count(*) AS n FROM b GROUP BY {by + ',' if by else ''} bin"""


@query(_bins(20))
def effort_bins(l):
    return r6(C.quantile_bins(C.working_set(l), 20))


@query(_bins(12, "gear"))
def effort_bins_by_gear(l):
    return r6(C.quantile_bins(C.working_set(l), 12, ["gear"]))


@query(_bins(10, "bmu"))
def effort_bins_by_unit(l):
    return r6(C.quantile_bins(C.working_set(l), 10, ["bmu"]))


@query("SELECT season, round(avg(cpue), 6) AS cpue_mean, round(avg(effort), 6) AS effort_mean, count(*) AS n FROM ws GROUP BY season")
def seasonal_means(l):
    return r6(C.means_by(C.working_set(l), "season"))


@query(", m AS (SELECT month, avg(cpue) AS c, avg(effort) AS e FROM ws GROUP BY month) SELECT round(corr(e, c), 6) AS r, count(*) AS n_months FROM m")
def monthly_correlation(l):
    return r6(C.monthly_correlation(C.working_set(l)))


@query(", y AS (SELECT year, avg(cpue) AS c, avg(effort) AS e FROM va WHERE year BETWEEN 1990 AND 2024 GROUP BY year) SELECT round(regr_slope(c, year), 6) AS cpue_slope, round(regr_slope(e, year), 6) AS effort_slope, count(*) AS n_years FROM y")
def annual_trend(l):
    return r6(C.annual_trend(C.valid_set(l), 1990, 2024))


def _groups(by: str, least: int, out: str = "gs") -> str:
    return f""", q AS (SELECT {by}, quantile_cont(effort, 0.25) AS lo, quantile_cont(effort, 0.75) AS hi, count(*) AS n FROM ws GROUP BY {by} HAVING count(*) >= {least}),
rk AS (SELECT {by}, corr(x, y) AS rho FROM (SELECT {by}, {ranks('effort', by)} AS x, {ranks('cpue', by)} AS y FROM ws) GROUP BY {by}),
g0 AS (SELECT {by}, any_value(n) AS n, median(effort) AS effort_med, stddev_samp(effort) / avg(effort) AS effort_cv, median(cpue) AS cpue_med, avg(cpue) AS cpue_mean, avg(cpue) FILTER (effort >= hi) / avg(cpue) FILTER (effort <= lo) AS depl_ratio, regr_slope(log_cpue, log_effort) AS log_slope,
  CASE WHEN count(DISTINCT year) > 2 THEN regr_slope(cpue, year) END AS cpue_trend, count(DISTINCT year) AS n_years FROM ws JOIN q USING ({by}) GROUP BY {by}),
{out} AS (SELECT g0.*, rho FROM g0 JOIN rk USING ({by}))"""


_GROUP = ["effort_med", "effort_cv", "cpue_med", "cpue_mean", "depl_ratio", "log_slope", "cpue_trend", "rho"]


@query(f"{_groups('gear', 30)} SELECT gear, n, n_years, {sql6(*_GROUP)}, CASE WHEN depl_ratio < 0.7 THEN 'strong' WHEN depl_ratio <= 0.9 THEN 'moderate' WHEN depl_ratio >= 1 THEN 'none' ELSE 'weak' END AS depletion FROM gs")
def gear_statistics(l):
    s = C.group_stats(C.working_set(l), "gear")
    return r6(s.select("gear", "n", "n_years", *_GROUP, C.depletion(F.col("depl_ratio")).alias("depletion")))


@query(f"{_groups('bmu', 30)} SELECT bmu, n, n_years, {sql6(*_GROUP)}, coalesce(rho > 0.1 AND cpue_trend < -0.05, false) AS hidden_depletion FROM gs")
def unit_statistics(l):
    return r6(C.hidden_depletion(C.group_stats(C.working_set(l), "bmu")).select("bmu", "n", "n_years", *_GROUP, "hidden_depletion"))


@query(f"{_groups('bmu', 30)}, k AS (SELECT bmu, coalesce(rho < -0.15, false)::INT + coalesce(depl_ratio < 0.65, false)::INT + coalesce(cpue_trend < -0.05, false)::INT AS risk_score FROM gs) SELECT bmu, risk_score, ['Low', 'Medium', 'High', 'CRITICAL'][risk_score + 1] AS risk FROM k")
def unit_risk(l):
    return C.risk(C.group_stats(C.working_set(l), "bmu")).select("bmu", "risk_score", "risk")


@query(", c AS (SELECT bmu, stddev_samp(effort) / avg(effort) AS cv, count(*) AS n FROM ws GROUP BY bmu) SELECT bmu, round(cv, 6) AS effort_cv, n, CASE WHEN cv < 0.3 THEN 'poor' WHEN cv < 0.5 THEN 'fair' WHEN cv < 0.7 THEN 'good' ELSE 'excellent' END AS feasibility FROM c")
def effort_variation(l):
    return r6(C.effort_cv_bands(C.working_set(l)))


#: The gears of the landing view, as feature columns.
GEARS = ["1-urgent", "2-high", "3-medium", "4-not specified", "5-low"]
_PCT = ["pct_" + g.replace("-", "_").replace(" ", "_") for g in GEARS]
_FEATURES = ["effort_mean", "effort_cv", "cpue_mean", "cpue_med", "rho", "cpue_trend", "depl_ratio", "gear_div", *_PCT]


@query(f"""{_groups('bmu', 50)}, sh AS (SELECT bmu, gear, count(*) AS g, avg(effort) AS e, count(*) / sum(count(*)) OVER (PARTITION BY bmu) AS p FROM ws GROUP BY bmu, gear),
mx AS (SELECT bmu, -sum(p * ln(p + 1e-9)) AS gear_div, arg_min(gear, (-g, gear)) AS dom_gear, sum(e * g) / sum(g) AS effort_mean, {", ".join(f"coalesce(sum(p) FILTER (gear = '{g}'), 0) AS {c}" for g, c in zip(GEARS, _PCT, strict=True))} FROM sh GROUP BY bmu),
md2 AS (SELECT median(effort_cv) AS m1, median(rho) AS m2, median(cpue_trend) AS m3, median(depl_ratio) AS m4 FROM gs)
SELECT bmu, n, dom_gear, round(effort_mean, 6) AS effort_mean, round(coalesce(effort_cv, m1), 6) AS effort_cv, {sql6('cpue_mean', 'cpue_med')}, round(coalesce(rho, m2), 6) AS rho, round(coalesce(cpue_trend, m3), 6) AS cpue_trend, round(coalesce(depl_ratio, m4), 6) AS depl_ratio, {sql6('gear_div', *_PCT)} FROM gs JOIN mx USING (bmu), md2""")
def unit_features(l):
    return r6(C.feature_matrix(C.working_set(l), GEARS).select("bmu", "n", "dom_gear", *_FEATURES))


_DEMEAN = """, dm AS (SELECT log_cpue - avg(log_cpue) OVER (PARTITION BY bmu) - avg(log_cpue) OVER (PARTITION BY year) + avg(log_cpue) OVER () AS y, log_effort - avg(log_effort) OVER (PARTITION BY bmu) - avg(log_effort) OVER (PARTITION BY year) + avg(log_effort) OVER () AS x FROM ws)"""


@query(f"{_DEMEAN} SELECT round(regr_slope(y, x), 6) AS beta, round(pow(corr(x, y), 2), 6) AS within_r2, count(*) AS n FROM dm")
def within_fit(l):
    return r6(C.within_fit(C.working_set(l)))


@query(", y AS (SELECT bmu, year, avg(log_cpue) AS m FROM ws WHERE year <= 1999 GROUP BY bmu, year) SELECT bmu, round(regr_slope(m, year), 6) AS slope, round(corr(year, m), 6) AS r, count(*) AS n_years FROM y GROUP BY bmu HAVING count(*) >= 3")
def pre_period_trends(l):
    return r6(C.pre_trends(C.working_set(l), 1999))


_LINE = ", ab AS (SELECT regr_slope(log_cpue, log_effort) AS b, regr_intercept(log_cpue, log_effort) AS a FROM ws), rs AS (SELECT log_cpue - a - b * log_effort AS e FROM ws, ab)"


@query(f"{_LINE} SELECT round(avg(e), 6) + 0 AS mean, round(stddev_samp(e), 6) AS std, round((sum(pow(e - m, 3)) / count(*)) / pow(sum(pow(e - m, 2)) / count(*), 1.5), 4) AS skew, round((sum(pow(e - m, 4)) / count(*)) / pow(sum(pow(e - m, 2)) / count(*), 2) - 3, 4) AS excess_kurtosis FROM rs, (SELECT avg(e) AS m FROM rs)")
def residual_moments(l):
    """Moments of the residuals of the log-log line."""
    df = C.working_set(l)
    at = C.ols(df).first()
    out = C.moments(df.select((F.col("log_cpue") - at.intercept - at.slope * F.col("log_effort")).alias("e")), "e")
    return out.select((F.round("mean", 6) + 0).alias("mean"), F.round("std", 6).alias("std"), F.round("skew", 4).alias("skew"), F.round("excess_kurtosis", 4).alias("excess_kurtosis"))


#: Two-sided p of Student's t for r over n pairs, by Simpson's rule on a power of the cosine from 0 to asin(|r|), which is the
#: density with t = sqrt(n - 2) tan.  Beyond 40 / sqrt(n - 2) the power is 0 to all digits, so that steps follow its width for any n.
_T_P = """greatest(0.0, 1 - 2 * CASE WHEN n_years > 2000 THEN sqrt((n_years - 2) / 2) * (1 - 0.25 / (n_years - 2) + 0.03125 / pow(n_years - 2, 2)) ELSE exp(lgamma((n_years - 1) / 2) - lgamma((n_years - 2) / 2)) END / sqrt(pi()) * far / 6000 * list_sum(list_transform(range(2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(cos(far * k / 2000), n_years - 3))))"""
_FAR = "least(asin(least(abs(r), 1)), 40 / sqrt(greatest(n_years - 2, 1)))"
_TRENDS = f""", y AS (SELECT bmu, year, avg(log_cpue) AS m FROM ws WHERE year <= 1997 GROUP BY bmu, year), tr AS (SELECT bmu, regr_slope(m, year) AS slope, corr(year, m) AS r, count(*) AS n_years FROM y GROUP BY bmu HAVING count(*) >= 3),
tt AS (SELECT *, {_FAR} AS far FROM tr), pt AS (SELECT bmu, slope, n_years, {_T_P} AS p FROM tt)"""


#: A correlation's p value and significance marks from r and n.
_P = _T_P.replace("n_years", "n")
_TEST = f"tt AS (SELECT *, {_FAR.replace('n_years', 'n')} AS far FROM rr), pp AS (SELECT *, {_P} AS p FROM tt)"
_STARS = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars"


def _tested(df, r):
    return C.with_p(df, r, "n", marks="stars").withColumn("p", F.round("p", 5)).withColumn(r, F.round(r, 6))


@query(f", r AS (SELECT {ranks('effort')} AS x, {ranks('cpue')} AS y FROM ws), rr AS (SELECT corr(x, y) AS r, count(*) AS n FROM r), {_TEST} SELECT round(r, 6) AS rho, n, round(p, 5) AS p, {_STARS} FROM pp")
def spearman_test(l):
    return _tested(C.spearman(C.working_set(l)), "rho")


@query(
    f", rr AS (SELECT regr_slope(log_cpue, log_effort) AS slope, regr_intercept(log_cpue, log_effort) AS intercept, corr(log_effort, log_cpue) AS r, count(*) AS n FROM ws), {_TEST} "
    f"SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r, n, round(p, 5) AS p, {_STARS} FROM pp"
)
def log_log_test(l):
    return r6(_tested(C.ols(C.working_set(l)), "r"))


@query(f", r AS (SELECT gear, {ranks('effort', 'gear')} AS x, {ranks('cpue', 'gear')} AS y FROM ws), rr AS (SELECT gear, corr(x, y) AS r, count(*) AS n FROM r GROUP BY gear), {_TEST} SELECT gear, round(r, 6) AS rho, n, round(p, 5) AS p, {_STARS} FROM pp")
def gear_tests(l):
    return _tested(C.spearman(C.working_set(l), by=["gear"]), "rho")


@query(f"{_TRENDS} SELECT bmu, round(slope, 6) AS slope, n_years, round(p, 5) AS p, p < 0.05 AS significant FROM pt")
def parallel_trends(l):
    return r6(C.parallel_trends(C.working_set(l), 1997).select("bmu", "slope", "n_years", F.round("p", 5).alias("p"), "significant"))


@query(f"{_TRENDS} SELECT count(*) AS n_units, count(*) FILTER (p < 0.05) AS n_significant, round(avg(slope), 6) AS mean_slope, CASE WHEN count(*) FILTER (p < 0.05) <= 3 THEN 'supported' ELSE 'partial concern' END AS verdict FROM pt")
def trends_verdict(l):
    return r6(C.trends_verdict(C.parallel_trends(C.working_set(l), 1997)))


@query(", y AS (SELECT bmu, year, avg(log_cpue) AS m FROM ws WHERE year <= 1997 GROUP BY bmu, year) SELECT bmu, year, round(m - b, 6) AS log_cpue_norm FROM y JOIN (SELECT bmu, m AS b FROM y WHERE year = 1996) USING (bmu)")
def normalised_trends(l):
    return r6(C.normalised_trends(C.working_set(l), 1996, 1997))


@query("SELECT bmu, round(avg(effort), 6) AS mean_effort, round(avg(cpue), 6) AS mean_cpue, round(avg(cpue) * (pow(0.7::DOUBLE, -0.1::DOUBLE) - 1) * 100, 6) AS cpue_gain FROM ws GROUP BY bmu")
def unit_gain(l):
    return r6(C.unit_gain(C.working_set(l), -0.1))


@query("SELECT gear, count(*) AS n, round(avg(log_cpue), 6) AS log_cpue_mean FROM ws WHERE gear IN ('1-urgent', '2-high') GROUP BY gear")
def gear_subset(l):
    return r6(C.gear_subset(C.working_set(l), ["1-URGENT", "2-HIGH"]).groupBy("gear").agg(F.count("*").alias("n"), F.avg("log_cpue").alias("log_cpue_mean")))


@query(f"{_bins(20).rsplit('SELECT', 1)[0].rstrip()}, bn AS (SELECT median(effort) AS x, avg(cpue) AS y, count(*) AS w FROM b GROUP BY bin), sm AS (SELECT sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM bn) SELECT round((w * xy - x * y) / (w * xx - x * x), 6) AS slope, round((y - (w * xy - x * y) / (w * xx - x * x) * x) / w, 6) AS intercept FROM sm")
def bin_line(l):
    return r6(C.weighted_line(C.quantile_bins(C.working_set(l), 20)))


def _logs(l: DataFrame) -> DataFrame:
    """Log columns are plain logarithms in the regressions."""
    return C.working_set(l).where("effort > 0 and cpue > 0").withColumn("log_cpue", F.log("cpue")).withColumn("log_effort", F.log("effort")).select("bmu", "year", "season", "gear", "effort", "log_effort", "log_cpue")


def _fitted(l: DataFrame) -> DataFrame:
    """All five specifications."""
    df = staged(_logs(l), "logs")
    cells = regression.cell_rows(df)
    rows = [regression.fit(df, s, rows=cells) for s in regression.SPECS]
    cols = ["spec", "beta", "se", "p", "low", "high", "r2", "adj_r2", "n"]
    return l.sparkSession.createDataFrame([tuple(r[c] for c in cols) for r in rows], "spec string, beta double, se double, p double, low double, high double, r2 double, adj_r2 double, n long")


def _fe_sql(specs: tuple[str, ...] = ("M1", "M2", "M3", "M4")) -> str:
    """Slope and fit of M1 to M4 without their dummies: by cell, both variables lose the means of each category in turn, 60 times over."""
    base = """, fx AS (SELECT bmu, year, season, gear, ln(effort) AS x, ln(cpue) AS y FROM ws WHERE effort > 0 AND cpue > 0),
fc AS (SELECT bmu, year, season, gear, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM fx GROUP BY ALL),
wi AS (SELECT sum(xx - n * mx * mx) AS xx, sum(xy - n * mx * my) AS xy, sum(yy - n * my * my) AS yy, sum(n) AS n, sum(yy) - pow(sum(n * my), 2) / sum(n) AS total FROM fc)"""
    parts, out = [], []
    for spec in specs:
        names = regression.SPECS[spec][0]
        step = f"SELECT k, bmu, year, season, gear, n, x, y FROM {spec}"
        for c in names:
            step = f"SELECT k, bmu, year, season, gear, n, x - sum(n * x) OVER (PARTITION BY {c}) / sum(n) OVER (PARTITION BY {c}) AS x, y - sum(n * y) OVER (PARTITION BY {c}) / sum(n) OVER (PARTITION BY {c}) AS y FROM ({step})"
        parts.append(f"{spec} AS (SELECT 0 AS k, bmu, year, season, gear, n, mx AS x, my AS y FROM fc UNION ALL SELECT k + 1 AS k, bmu, year, season, gear, n, x, y FROM ({step}) WHERE k < 60)")
        out.append(f"SELECT '{spec}' AS spec, round((any_value(wi.xy) + sum(f.n * x * y)) / (any_value(wi.xx) + sum(f.n * x * x)), 6) AS beta, round(1 - (any_value(wi.yy) + sum(f.n * y * y) - pow(any_value(wi.xy) + sum(f.n * x * y), 2) / (any_value(wi.xx) + sum(f.n * x * x))) / any_value(wi.total), 6) AS r2, any_value(wi.n)::BIGINT AS n FROM {spec} f, wi WHERE k = 60")
    return f"{base}, {', '.join(parts)} {' UNION ALL '.join(out)}"


@query(_fe_sql())
def fixed_effects_slopes(l):
    df = staged(_logs(l), "logs")
    cells = regression.cell_rows(df)
    rows = [regression.fit(df, s, rows=cells) for s in ("M1", "M2", "M3", "M4")]
    return r6(l.sparkSession.createDataFrame([(r["spec"], r["beta"], r["r2"], r["n"]) for r in rows], "spec string, beta double, r2 double, n long"))


@query(_fe_sql(("M2", "M4")))
def absorbed_effects(l):
    """Slope and fit with the units' effects absorbed: no matrix of units."""
    df = _logs(l)
    rows = [fit_absorbed(df, s)[0] for s in ("M2", "M4")]
    return r6(l.sparkSession.createDataFrame([(r["spec"], r["beta"], r["r2"], r["n"]) for r in rows], "spec string, beta double, r2 double, n long"))


@query(None)
def residual_diagnostics(l):
    """Moments of the residuals of M4, and the normal quantile pairs' correlation."""
    df = staged(_logs(l), "logs")
    out = staged(regression.residuals(df, regression.fit(df, "M4")).select("bmu", "effort", "log_cpue", "residual"), "residuals")
    pairs = regression.quantile_pairs(out, "residual").agg(F.corr("theoretical", "sample").alias("qq_r"))
    some = regression.sampled(out, 4_900, ["bmu", "effort", "log_cpue"]).select("residual").limit(5_000).toPandas()["residual"]  # the test's own limit
    w, p = regression.shapiro(some.to_numpy())
    told = C.moments(out, "residual").crossJoin(F.broadcast(pairs))  # one row each
    return told.withColumn("shapiro_w", F.lit(w)).withColumn("shapiro_p", F.lit(p))


_CURVE_AT = [k / 20 for k in range(21)]


@query(
    f""", pl AS (SELECT DISTINCT unnest(quantile_cont(effort, {_CURVE_AT})) AS place FROM ws), g AS (SELECT effort AS x, count(*) AS n, sum(cpue) AS s FROM ws GROUP BY effort),
k AS (SELECT greatest(2, ceil(0.3 * sum(n))) AS k FROM g),
a AS (SELECT place, x - place AS t, n, s, sum(n) OVER (PARTITION BY place ORDER BY abs(x - place)) AS met FROM g, pl),
h AS (SELECT place, min(abs(t)) AS h FROM a, k WHERE met >= k GROUP BY place),
w AS (SELECT place, t, n, s, CASE WHEN abs(t) < CASE WHEN h > 0 THEN h ELSE 1 END THEN pow(1 - pow(abs(t) / CASE WHEN h > 0 THEN h ELSE 1 END, 3), 3) ELSE 0 END AS w FROM a JOIN h USING (place)),
m AS (SELECT place, sum(w * n) AS sw, sum(w * n * t) AS st, sum(w * n * t * t) AS stt, sum(w * s) AS sy, sum(w * t * s) AS sty FROM w GROUP BY place)
SELECT round(place, 6) AS place, round((sy - CASE WHEN stt - st * st / sw > 0 THEN (sty - st * sy / sw) / (stt - st * st / sw) ELSE 0 END * st) / sw, 6) AS fitted FROM m"""
)
def effort_curve_whole(l):
    """The curve over all rows, at 21 quantiles of effort."""
    df = C.working_set(l).select("effort", "cpue")
    places = many_quantiles(df, {"effort": _CURVE_AT}).first()
    return r6(regression.local_line(df, "effort", "cpue", sorted(set(places.effort)) if places else [0.0], 0.3))


@query(None)
def effort_curve(l):
    """A locally weighted curve of cpue over effort on a sample of 12,000 rows at most, at 100 places of effort."""
    df = regression.sampled(C.working_set(l).select("effort", "cpue", "l_orderkey", "l_linenumber"), 12_000, ["l_orderkey", "l_linenumber"])
    rows = df.orderBy("effort", "cpue", "l_orderkey", "l_linenumber").select("effort", "cpue").toPandas()
    step = max(1, len(rows) // 100)
    fitted = regression.lowess(rows["effort"].to_numpy(), rows["cpue"].to_numpy(), 0.3, 0)
    return l.sparkSession.createDataFrame([(float(rows["effort"][i]), float(fitted[i])) for i in range(0, len(rows), step)], "effort double, cpue_smooth double")


@query(None)
def landings_map(l):
    """A map of all landings by effort, catch rate and size of crew: rows and mean distance of each node."""
    columns = ["log_effort", "log_cpue", "total_fishers"]
    df = som.standardised(C.working_set(l).select(*columns), columns)
    told = som.BatchMap(6, 6).fit(df, columns).assign(df)
    return r6(told.groupBy("node").agg(F.count("*").alias("n"), F.avg("distance").alias("mean_distance")))


@query(None)
def fixed_effects_models(l):
    return _fitted(l)
