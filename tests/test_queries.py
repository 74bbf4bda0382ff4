"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows) if all(None not in r for r in rows) else sorted(map(str, rows))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    want = duck.sql(ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert plain([tuple(r) for r in got.select(*[f"`{c}`" for c in order]).collect()]) == plain([tuple(r) for r in want.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_every_query_without_sql_is_of_the_removable_part():
    assert {n for n in entry.queries() if n not in ORACLES} <= {n for n in entry.queries() if n.startswith("op") or n == "pipeline"}
