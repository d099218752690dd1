"""Every registered query against its SQL on the smallest data folder."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracle import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_entry(spark):
    assert entry(spark).count() == 8


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    others = set(queries()) - set(oracle_sql())
    assert {name for name in others if not name.startswith(("op", "pipeline"))} == set()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    df = queries()[name](spark, FOLDER)
    cursor = con.execute(oracle_sql()[name])
    names = [item[0] for item in cursor.description]
    assert sorted(df.columns) == sorted(names)
    found = rows_of(df.columns, [tuple(row) for row in df.collect()])
    assert found == rows_of(names, cursor.fetchall())
