"""Every registered query against its DuckDB oracle on the sf0.001 tables,
plus the entry smoke check."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from sieve.plans.catalog import ORACLE as SQL
from sieve.plans.catalog import QUERIES
from sieve.sources.tables import TEST_TABLES

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle_or_is_listed():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "violation_count" in df.columns


def test_approx_iqr_close_to_exact(spark):
    a = QUERIES["o8_iqr_approx_events"](spark, SF_SMALL).count()
    b = QUERIES["o5_iqr_cont_events"](spark, SF_SMALL).count()
    assert abs(a - b) <= max(2, 0.05 * b)
