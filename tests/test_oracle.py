"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

from checks.catalog import QUERIES
from checks.compare import TABLES, compare
from checks.oracle import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    same, text = compare(spark, con, name, SF)
    assert same, text
