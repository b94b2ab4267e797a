"""Queries that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from harness import same

from strataloom import llm

QUERIES, ORACLES = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_oracle(spark, name):
    same(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
