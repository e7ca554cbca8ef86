"""Every registered query against its SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as registered
import verify
from casewright.plans import catalog

SF_DIR = registered.SMOKE_DIR


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in verify.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, database, name):
    result = registered.queries()[name](spark, SF_DIR)
    mine = verify.rows_of(result.columns, result.collect())
    sql = registered.oracle_sql().get(name)
    if sql is None:
        assert mine
        return
    cursor = database.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert mine == verify.rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert registered.entry(spark).count() > 0
