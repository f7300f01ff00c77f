"""Fixed-effects regressions from grouped moments, and small-sample numerics on the driver.

The regressors are log effort, its category dummies and effort²: one aggregate by (unit, year, season, gear) holds all
products that X'X, X'y and the cluster scores need, so the data are read once and the driver sees the cells only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = ["bmu", "year", "season", "gear"]
#: Reference levels of the dummies (a level that doesn't occur falls back to the first by name).
REFERENCES = {"gear": "nets", "season": "SE Monsoon (JJAS)"}


def cells(df: DataFrame) -> DataFrame:
    """Moments by cell of the rows that have unit, year, season and gear (others, as rows without a date, can't have effects): n, and sums of x, x², y, xy, y², e², e⁴, xe², ye² (x log effort, y log cpue, e effort)."""
    x, y, e2 = F.col("log_effort"), F.col("log_cpue"), F.pow("effort", 2)
    s = lambda c, n: F.sum(c).alias(n)
    return df.where(" and ".join(f"{c} is not null" for c in CELLS)).groupBy(*CELLS).agg(F.count("*").alias("n"), s(x, "x"), s(x * x, "xx"), s(y, "y"), s(x * y, "xy"), s(y * y, "yy"), s(e2, "e"), s(e2 * e2, "ee"), s(x * e2, "xe"), s(y * e2, "ye"))


def t_sf(t: float, df: float) -> float:
    """Two-sided p value of Student's t, by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t):
        return 0.0
    return _betai(df / 2, 0.5, df / (df + t * t))


def _betai(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def normal_sf(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def correlation_p(r: float, n: int) -> float:
    """p value of Pearson's or Spearman's coefficient."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else float("nan")
    return t_sf(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


#: Specification -> category effects and whether effort² is a regressor.  Gear is left out for one gear group.
SPECS = {"M1": (["gear", "season"], False), "M2": (["gear", "season", "bmu"], False), "M3": (["gear", "season", "year"], False), "M4": (["gear", "season", "bmu", "year"], False), "M5": (["gear", "season", "bmu", "year"], True)}


def cell_rows(df: DataFrame) -> list[dict]:
    """cells() on the driver: units x years x seasons x gears.  Several fits of the same rows can share them."""
    return [r.asDict() for r in cells(df).collect()]


def fit(df: DataFrame, spec: str = "M4", cluster: str = "bmu", rows: list[dict] | None = None) -> dict:
    """Least squares of log cpue on log effort with a specification's effects.

    Standard errors: HC3 for M1 (a second pass with each row's leverage), clustered by unit with the small-sample factor
    else; p values and bounds by normal quantiles.  rows: cell_rows(df), if they are known.  Effects of very many levels are for
    absorbed.fit_absorbed(), which makes no matrix of them.  Returns beta, se, p, low, high, r2, adj_r2, n, and all coefficients."""
    rows = cell_rows(df) if rows is None else rows
    names, squared = SPECS[spec]
    levels = {}
    for c in names:
        found = sorted({r[c] for r in rows})
        first = REFERENCES.get(c) if REFERENCES.get(c) in found else found[0]
        levels[c] = [v for v in found if v != first]
    columns = ["const", "log_effort", *(["effort_sq"] if squared else []), *[f"{c}={v}" for c in names for v in levels[c]]]
    at, k = {c: i for i, c in enumerate(columns)}, len(columns)
    xtx, xty, yy, n, ysum = np.zeros((k, k)), np.zeros(k), 0.0, 0, 0.0
    parts: dict = {}
    for r in rows:
        ones = [0, *[at[f"{c}={r[c]}"] for c in names if f"{c}={r[c]}" in at]]
        a, b = np.zeros((k, k)), np.zeros(k)
        a[np.ix_(ones, ones)] += r["n"]
        a[1, ones] += r["x"]
        a[ones, 1] += r["x"]
        a[1, 1] += r["xx"]
        b[ones] += r["y"]
        b[1] += r["xy"]
        if squared:
            a[2, ones] += r["e"]
            a[ones, 2] += r["e"]
            a[1, 2] += r["xe"]
            a[2, 1] += r["xe"]
            a[2, 2] += r["ee"]
            b[2] += r["ye"]
        xtx, xty, yy, n, ysum = xtx + a, xty + b, yy + r["yy"], n + r["n"], ysum + r["y"]
        g = parts.setdefault(r[cluster], [np.zeros((k, k)), np.zeros(k)])
        g[0] += a
        g[1] += b
    inv = np.linalg.pinv(xtx)
    beta = inv @ xty
    if spec == "M1":
        meat = _hc3(df, columns, names, levels, beta, inv)
    else:
        scores = [b - a @ beta for a, b in parts.values()]
        g = len(parts)
        meat = sum(np.outer(s, s) for s in scores) * (g / max(1, g - 1)) * ((n - 1) / (n - k))
    se = np.sqrt(np.maximum(np.diag(inv @ meat @ inv), 0))
    total = yy - ysum**2 / n
    r2 = 1 - (yy - beta @ xty) / total
    z = 1.959963984540054
    return {"spec": spec, "beta": float(beta[1]), "se": float(se[1]), "p": normal_sf(beta[1] / se[1]) if se[1] else 0.0, "low": float(beta[1] - z * se[1]), "high": float(beta[1] + z * se[1]), "r2": float(r2), "adj_r2": float(1 - (1 - r2) * (n - 1) / (n - k)), "n": int(n), "coefficients": dict(zip(columns, beta.tolist(), strict=True))}


def _hc3(df: DataFrame, columns: list[str], names: list[str], levels: dict, beta: np.ndarray, inv: np.ndarray) -> np.ndarray:
    """Sum of x x' (residual / (1 - leverage))²: rows of one cell share all but log effort, so their leverage is a quadratic in it and the sum needs three moments for each cell."""
    at = {c: i for i, c in enumerate(columns)}
    df = df.where(" and ".join(f"{c} is not null" for c in CELLS))
    key = F.concat_ws("\x1f", *names)
    base = {}
    for r in df.select(*names).distinct().collect():
        v = np.zeros(len(columns))
        v[[0, *[at[f"{c}={r[c]}"] for c in names if f"{c}={r[c]}" in at]]] = 1
        base["\x1f".join(str(r[c]) for c in names)] = (v, float(v @ beta), float(v @ inv @ v), float(v @ inv[:, 1]))
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, t in base.items() for x in (k, t[i])]), F.col("_k"))
    x = F.col("log_effort")
    leverage = pick(2) + 2 * pick(3) * x + float(inv[1, 1]) * x * x
    w = F.pow((F.col("log_cpue") - pick(1) - float(beta[1]) * x) / (1 - leverage), 2)
    sums = df.withColumn("_k", key).withColumn("_w", w).groupBy("_k").agg(F.sum("_w").alias("a"), F.sum(F.col("_w") * x).alias("b"), F.sum(F.col("_w") * x * x).alias("c")).collect()
    meat = np.zeros((len(columns), len(columns)))
    for r in sums:
        v = base[r["_k"]][0]
        meat += r["a"] * np.outer(v, v)
        meat[1] += r["b"] * v
        meat[:, 1] += r["b"] * v
        meat[1, 1] += r["c"]
    return meat


def residuals(df: DataFrame, result: dict, name: str = "residual") -> DataFrame:
    """df (rows with all effects' columns) with fitted and the residual of a fit; effects come as a map of the levels."""
    names, squared = SPECS[result["spec"]]
    c = result["coefficients"]
    fitted = F.lit(c["const"]) + F.lit(c["log_effort"]) * F.col("log_effort")
    if squared:
        fitted = fitted + F.lit(c["effort_sq"]) * F.pow("effort", 2)
    for n in names:
        levels = {k.split("=", 1)[1]: v for k, v in c.items() if k.startswith(f"{n}=")}
        if levels:
            known = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
            fitted = fitted + F.coalesce(F.element_at(known, F.col(n).cast("string")), F.lit(0.0))
    out = df.where(" and ".join(f"{c} is not null" for c in CELLS)).withColumn("fitted", fitted)
    return out.withColumn(name, F.col("log_cpue") - F.col("fitted"))


def quantile_pairs(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """theoretical, sample: quantiles of the normal distribution against the column's exact ones, at `points` even places."""
    from statistics import NormalDist

    from .quantiles import first_of, quantiles

    parts = [(k + 0.5) / points for k in range(points)]
    normal = F.array(*[F.lit(NormalDist().inv_cdf(p)) for p in parts])
    return quantiles(df, column, parts).select(F.inline(F.arrays_zip(normal.alias("theoretical"), F.col("q").alias("sample"))))


def sampled(df: DataFrame, rows: int, key: list[str], seed: int = 42) -> DataFrame:
    """About `rows` rows (all if there are fewer), chosen by a hash of their key and the seed, so the same in every run."""
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def fixed_effects(result: dict, of: str) -> list[tuple[str, float]]:
    """Effects of a category's levels, the reference 0 left out, in rising order."""
    return sorted(((k.split("=", 1)[1], v) for k, v in result["coefficients"].items() if k.startswith(f"{of}=")), key=lambda x: x[1])


def effects_correlation(a: dict, b: dict, of: str = "bmu") -> float:
    """Pearson's r of two fits' effects over the levels both have."""
    x, y = dict(fixed_effects(a, of)), dict(fixed_effects(b, of))
    both = sorted(x.keys() & y.keys())
    return float(np.corrcoef([x[k] for k in both], [y[k] for k in both])[0, 1]) if len(both) > 1 else float("nan")


def response(beta: float, mean_effort: float, mean_cpue: float, grid: list[float]) -> list[tuple[float, float]]:
    """Constant-elasticity curve through the means."""
    return [(e, mean_cpue * (e / mean_effort) ** beta) for e in grid]


def lowess(x: np.ndarray, y: np.ndarray, part: float = 0.3, rounds: int = 3) -> np.ndarray:
    """Locally weighted lines (Cleveland 1979) of a driver-side sample: fitted values in the order of x."""
    order = np.argsort(x, kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    n, out, robust = len(x), np.zeros(len(x)), np.ones(len(x))
    k = max(2, int(math.ceil(part * n)))
    for _ in range(rounds + 1):
        left = 0
        for i in range(n):
            while left + k < n and x[left + k] - x[i] < x[i] - x[left]:
                left += 1
            s = slice(left, left + k)
            reach = max(x[i] - x[left], x[min(left + k, n) - 1] - x[i]) or 1.0
            w = np.clip(1 - np.clip(np.abs(x[s] - x[i]) / reach, 0, 1) ** 3, 0, 1) ** 3 * robust[s]
            sw = w.sum()
            mx, my = (w @ x[s]) / sw if sw else x[i], (w @ y[s]) / sw if sw else y[i]
            var = w @ (x[s] - mx) ** 2
            out[i] = my + ((w @ ((x[s] - mx) * (y[s] - my))) / var * (x[i] - mx) if var > 0 else 0)
        resid = np.abs(y - out)
        scale = 6 * np.median(resid)
        robust = np.clip(1 - (resid / scale) ** 2, 0, 1) ** 2 if scale > 0 else np.ones(n)
    return out[np.argsort(order, kind="stable")]


def local_line(df: DataFrame, x: str, y: str, places: list[float], part: float = 0.3) -> DataFrame:
    """place, fitted: tricube-weighted lines through the nearest `part` of all rows around each place, as lowess() without its
    robust rounds, over the whole table.

    Rows are summed up by different x first; a place's reach is the distance at which so many rows are met.  Sums are taken
    around the place, so that they lose no digits; of rows as far as the reach all count alike (with weight 0, or 1 if the reach is
    0).  Rows that lack a value take no part; no rows give no places."""
    from pyspark.sql import Window as W

    from ..sources.staging import staged

    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    sums = staged(rows.groupBy("x").agg(F.count("*").alias("n"), F.sum("y").alias("s")), "local-line")
    total = sums.agg(F.sum("n")).first()[0] or 0
    k = max(2, math.ceil(part * total))
    at = sums.withColumn("place", F.explode(F.array(*[F.lit(float(p)) for p in places]))).withColumn("t", F.col("x") - F.col("place"))
    met = F.sum("n").over(W.partitionBy("place").orderBy(F.abs("t")))
    at = at.withColumn("met", met).withColumn("reach", F.min(F.when(F.col("met") >= min(k, total), F.abs("t"))).over(W.partitionBy("place")))
    u = F.abs("t") / F.when(F.col("reach") > 0, F.col("reach")).otherwise(1.0)
    w = F.when(u < 1, F.pow(1 - F.pow(u, 3), 3)).otherwise(0.0)
    s = lambda v: F.sum(F.col("w") * v)
    n, t = F.col("n"), F.col("t")
    out = at.withColumn("w", w).groupBy("place").agg(s(n).alias("sw"), s(n * t).alias("st"), s(n * t * t).alias("stt"), s(F.col("s")).alias("sy"), s(t * F.col("s")).alias("sty"))
    spread = F.col("stt") - F.col("st") * F.col("st") / F.col("sw")
    slope = F.when(spread > 0, (F.col("sty") - F.col("st") * F.col("sy") / F.col("sw")) / F.when(spread > 0, spread)).otherwise(0.0)
    return out.where("sw > 0").select("place", ((F.col("sy") - slope * F.col("st")) / F.col("sw")).alias("fitted"))


def shapiro(values: np.ndarray) -> tuple[float, float]:
    """(W, p) of Shapiro and Wilk's test of normality by Royston's approximation (1995), for 3 to 5,000 values.  Constants are the published ones."""
    from statistics import NormalDist

    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        raise ValueError("three values at least, not all equal")
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), n**-0.5
    if n == 3:
        a = np.array([-(0.5**0.5), 0.0, 0.5**0.5])
    else:
        ends = [m[-1] / mm**0.5 + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u)]
        if n > 5:
            ends.insert(0, m[-2] / mm**0.5 + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u))
        k = len(ends)
        rest = (mm - 2 * float(m[-k:] @ m[-k:])) / (1 - 2 * sum(e * e for e in ends))
        a = np.concatenate([-np.array(ends[::-1]), m[k:-k] / rest**0.5, ends])
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(w**0.5) - math.asin(0.75**0.5)))
    if w >= 1:
        return w, 1.0
    if n <= 11:
        g = 0.459 * n - 2.273
        v = math.log(1 - w)
        if v >= g:
            return w, 0.0
        z = (-math.log(g - v) - np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)) / math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        z = (math.log(1 - w) - np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], math.log(n))) / math.exp(np.polyval([0.0030302, -0.082676, -0.4803], math.log(n)))
    return w, 0.5 * math.erfc(z / math.sqrt(2))


def polyfit(bins: list[tuple[float, float, float]], degree: int) -> list[float]:
    """Weighted polynomial through (x, y, n), weights sqrt(n), highest power first."""
    x, y, n = (np.array(v, float) for v in zip(*bins, strict=True))
    return np.polyfit(x, y, degree, w=np.sqrt(n)).tolist()


def pca(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(percent of variance, loadings by column, scores) of the standardised (population deviation) matrix."""
    z = (matrix - matrix.mean(0)) / np.where(matrix.std(0) > 0, matrix.std(0), 1)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    return 100 * s**2 / (s**2).sum(), vt.T, u * s


class SelfOrganisingMap:
    """A rectangular map trained by single random samples with a decaying Gaussian neighbourhood."""

    def __init__(self, rows: int = 6, cols: int = 6, sigma: float = 1.5, rate: float = 0.5, seed: int = 42):
        self.shape, self.sigma, self.rate, self.seed = (rows, cols), sigma, rate, seed

    def fit(self, data: np.ndarray, steps: int = 10_000) -> SelfOrganisingMap:
        rng = np.random.default_rng(self.seed)
        self.weights = data[rng.integers(0, len(data), self.shape)].astype(float) + rng.normal(0, 1e-3, (*self.shape, data.shape[1]))
        i, j = np.indices(self.shape)
        for t in range(steps):
            x = data[rng.integers(len(data))]
            fade = 1 / (1 + t / (steps / 2))
            a, b = self.winner(x)
            near = np.exp(-((i - a) ** 2 + (j - b) ** 2) / (2 * (self.sigma * fade) ** 2))
            self.weights += (self.rate * fade * near)[..., None] * (x - self.weights)
        return self

    def winner(self, x: np.ndarray) -> tuple[int, int]:
        return tuple(int(v) for v in np.unravel_index(((self.weights - x) ** 2).sum(-1).argmin(), self.shape))

    def quantisation_error(self, data: np.ndarray) -> float:
        return float(np.mean([np.linalg.norm(x - self.weights[self.winner(x)]) for x in data]))

    def distances(self) -> np.ndarray:
        """Mean distance of each node to its neighbours."""
        out = np.zeros(self.shape)
        for i, j in np.ndindex(self.shape):
            near = [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= i + a < self.shape[0] and 0 <= j + b < self.shape[1]]
            out[i, j] = np.mean([np.linalg.norm(self.weights[i, j] - self.weights[p]) for p in near])
        return out
