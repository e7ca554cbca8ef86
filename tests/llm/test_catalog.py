"""Every query of this part at the smallest scale, against its SQL where there is one."""

import duckdb
import pytest

import __spark_entry__ as registered
import verify
from casewright.llm import catalog

SF_DIR = registered.SMOKE_DIR


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in verify.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_all_are_registered():
    names = registered.queries()
    assert {*catalog.QUERIES, "pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, len(catalog.QUERIES) + 1))
    assert set(catalog.ORACLES) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", [*sorted(catalog.QUERIES), "pipeline"])
def test_query(spark, database, name):
    result = registered.queries()[name](spark, SF_DIR)
    mine = verify.rows_of(result.columns, result.collect())
    assert mine
    if name in catalog.ORACLES:
        cursor = database.execute(catalog.ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(result.columns)
        assert mine == verify.rows_of(columns, cursor.fetchall())
