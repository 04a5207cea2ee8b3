"""Every registered query against its SQL restatement on the test tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from oreline.plans.oracles import ORACLES
from oreline.sources.paths import clear_scratch
from oreline.plans.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
SOURCES = ["customer", "part", "orders", "lineitem"]

# Logical type names of the two engines.
_SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in SOURCES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return connection


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()


def _sort_key(row):
    return tuple((v is not None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    reference = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]}) q")
    types = dict(zip(reference.columns, map(str, reference.types)))
    for column, kind in got.dtypes:
        assert types[column] == _SAME_TYPE.get(kind, kind.upper()), column
    expected = reference.fetchall()
    actual = [tuple(r) for r in got.select(*columns).collect()]
    assert len(expected) > 0
    assert sorted(actual, key=_sort_key) == sorted(expected, key=_sort_key)
    clear_scratch(spark)
