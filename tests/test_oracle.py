"""Every registered query against its SQL counterpart in DuckDB, values and types."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from fileledger.catalog.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")

# Types that hold the same values in both engines.
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS FROM '{SF_DIR}/{file}'")
    yield connection
    connection.close()


def _sortable(row):
    return tuple((value is not None, str(type(value)), value) for value in row)


def test_every_query_has_sql():
    assert QUERIES.keys() <= oracle_sql().keys()
    assert oracle_sql().keys() <= queries().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    types = {field.name: field.dataType.simpleString() for field in result.schema}
    relation = duck.sql(oracle_sql()[name])
    assert sorted(relation.columns) == columns
    expected_types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: SAME_TYPE[t] for c, t in types.items()} == expected_types

    got = [tuple(row) for row in result.select(*columns).collect()]
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = relation.project(quoted).fetchall()
    assert len(got) > 0
    assert sorted(got, key=_sortable) == sorted(expected, key=_sortable)


def test_entry(spark):
    assert entry(spark).count() == 11
