"""Every query that has a SQL counterpart gives the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import TABLES, rows_of

ORACLES = entry_point.oracle_sql()
QUERIES = entry_point.queries()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(ORACLES[name])
    want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert columns == want_columns
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() > 0
