"""Every registered query against its SQL restatement in DuckDB."""

import importlib.util
import os

import duckdb
import pytest

from playgauge.plans import catalog, oracles

FOLDER = os.environ.get("PLAYGAUGE_TEST_DATA", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events".split()
SQL_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


ENTRY = _entry()
QUERIES, SQL = catalog.registered(), oracles.statements()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def _sortable(row):
    return tuple((value is None, "" if value is None else value) for value in row)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(ENTRY.queries()) and set(SQL) <= set(ENTRY.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    expected = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {f.name: SQL_TYPES[f.dataType.simpleString()] for f in df.schema.fields} == types
    at = [expected.columns.index(c) for c in columns]
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=_sortable)
    want = sorted((tuple(row[i] for i in at) for row in expected.fetchall()), key=_sortable)
    assert got == want


def test_flagship_runs(spark):
    assert ENTRY.entry(spark).count() > 0
