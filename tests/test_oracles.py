"""Every registered query against its SQL oracle at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks import oracles
from checks.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("pages", "labels", "events"):
        connection.sql(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracles.statements())
    assert set(QUERIES) <= set(entry.queries()) and set(oracles.statements()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    got_rows = sorted(repr([r[c] for c in columns]) for r in df.collect())
    order = [want.columns.index(c) for c in columns]
    assert got_rows == sorted(repr([r[i] for i in order]) for r in want.fetchall())
