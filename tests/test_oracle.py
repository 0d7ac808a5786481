"""Every query with SQL gives the same rows in an independent engine."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, difference

SQL = entry.oracle_sql()
# the category lists in these statements are those of the larger tables
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert difference(got, con.execute(SQL[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
