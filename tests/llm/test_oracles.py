"""The training-data queries against their SQL restatements on the test tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from oreline.llm.queries import LLM_ORACLES, LLM_QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_oracle(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    found = LLM_QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({LLM_ORACLES[name]}) q").fetchall()
    assert len(expected) > 0
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, expected))


def test_every_query_is_registered():
    numbers = sorted(int(name.split("_")[0][2:]) for name in LLM_QUERIES)
    assert numbers == list(range(1, 14))
