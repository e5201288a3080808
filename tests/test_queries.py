"""Every registered query against its oracle SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, normalized


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, oracle, name):
    got = entry.queries()[name](spark, sf).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = oracle.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normalized(got) == normalized(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5
