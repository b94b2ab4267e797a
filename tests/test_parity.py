"""Queries against their oracles on the smallest tables."""

from __future__ import annotations

import pytest
from harness import same

from strataloom import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_oracle(spark, name):
    same(spark, QUERIES[name], ORACLES[name], FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
