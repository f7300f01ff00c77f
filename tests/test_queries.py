"""Every registered query with SQL gives the SQL's rows on the smallest tables; the others give rows."""

import os

import pytest

from tidewake import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
SLOW = {"vessel_predictions", "gear_predictions", "unit_clusters"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    def cell(v):
        if v is None or v != v:
            return "-"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.8g}" if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLES])
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert plain([r.asDict() for r in df.collect()], columns) == plain(want, columns)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES and n not in SLOW])
def test_rows_only(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert queries.FLAGSHIP in e.queries()
