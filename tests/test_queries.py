"""Every query against its SQL in DuckDB, on the given tables."""

import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = os.environ.get("QUERY_FOLDER", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return value.item() if hasattr(value, "item") else value


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, db, name):
    result = queries()[name](spark, FOLDER)
    expected = db.sql(oracle_sql()[name])
    assert sorted(result.columns) == sorted(expected.columns)
    expected_types = dict(zip(expected.columns, map(str, expected.types)))
    for column, kind in result.dtypes:
        assert TYPES.get(kind, expected_types[column]) == expected_types[column], column
    got = rows_of([tuple(r) for r in result.collect()], result.columns)
    want = rows_of(expected.fetchall(), expected.columns)
    assert len(want) > 0
    assert got == want


def test_queries_without_sql(spark):
    for name in sorted(set(queries()) - set(oracle_sql())):
        assert queries()[name](spark, FOLDER).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
