import pytest
from pyspark.sql import functions as F

from tidewake.operators import regression as G
from tidewake.operators.absorbed import fit_absorbed


def catches(spark, units, rows, noise=True):
    i = F.col("id")
    draw = lambda k, m: F.pmod(F.xxhash64(F.lit(k), i), F.lit(m))
    df = spark.range(rows).select(
        F.concat(F.lit("u|"), draw("u", units).cast("string")).alias("bmu"), (1995 + draw("y", 30)).cast("int").alias("year"),
        F.get(F.array(*map(F.lit, ("a|b", "a", "SE Monsoon (JJAS)"))), draw("s", 3).cast("int")).alias("season"), F.get(F.array(*map(F.lit, ("nets", "lines"))), draw("g", 2).cast("int")).alias("gear"),
        ((1 + draw("e", 1000)) / 100.0).alias("effort"), (draw("n", 2001) / 1000.0 - 1).alias("noise"),
    )
    unit = F.pmod(F.xxhash64("bmu"), F.lit(97)) / 50.0
    y = -0.3 * F.log("effort") + unit + 0.01 * F.col("year") + F.when(F.col("gear") == "lines", 0.4).otherwise(0.0) + F.when(F.col("season") == "a", 0.2).otherwise(0.0)
    return df.withColumn("log_effort", F.log("effort")).withColumn("log_cpue", y + (F.col("noise") if noise else 0))


@pytest.mark.parametrize("spec", ["M2", "M4", "M5"])
def test_equals_the_dense_fit(spark, spec):
    df = catches(spark, 23, 1500)
    want, (got, effects) = G.fit(df, spec), fit_absorbed(df, spec)
    for name in ("beta", "se", "p", "low", "high", "r2", "adj_r2", "n"):
        assert got[name] == pytest.approx(want[name], rel=1e-6, abs=1e-9), name
    for name, v in got["coefficients"].items():
        assert v == pytest.approx(want["coefficients"][name], rel=1e-6, abs=1e-8)
    dense = {k.split("=", 1)[1]: v for k, v in want["coefficients"].items() if k.startswith("bmu=")}
    table = {r.bmu: r.effect for r in effects.collect()}
    assert len(table) == 23
    first = min(table)
    assert table[first] == pytest.approx(want["coefficients"]["const"], abs=1e-7)
    assert all(table[b] - table[first] == pytest.approx(v, abs=1e-7) for b, v in dense.items())


def test_fifty_thousand_units_and_thirty_years(spark):
    result, effects = fit_absorbed(catches(spark, 50_000, 300_000, noise=False), "M4")
    assert result["beta"] == pytest.approx(-0.3, abs=1e-6) and result["r2"] == pytest.approx(1, abs=1e-6)
    assert len(result["coefficients"]) == 1 + 1 + 2 + 29 and 49_000 < effects.count() <= 50_000
    assert result["coefficients"]["gear=lines"] == pytest.approx(0.4, abs=1e-6)


def test_other_specifications(spark):
    df = catches(spark, 5, 100)
    with pytest.raises(ValueError, match="no effects of bmu"):
        fit_absorbed(df, "M1")
    years, effects = fit_absorbed(df, "M4", absorb="year")
    assert years["beta"] == pytest.approx(G.fit(df, "M4", cluster="year")["beta"]) and effects.count() <= 30
