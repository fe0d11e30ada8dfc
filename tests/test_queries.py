"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from check_queries import TABLES, comparable

FOLDER = "/root/testdata/sf0.001"
QUERIES, EXPECTED = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = comparable([tuple(r) for r in df.collect()], df.columns)
    if name not in EXPECTED:
        assert got[1]
        return
    result = con.execute(EXPECTED[name])
    names = [d[0] for d in result.description]
    assert got == comparable(result.fetchall(), names)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 1


def test_every_sql_belongs_to_a_query():
    assert set(EXPECTED) <= set(QUERIES)
