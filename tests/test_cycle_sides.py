"""Peeling, components and cycles: the sides of every join are named, and what grows with the input is never broadcast."""

from __future__ import annotations

import random

import pytest

from strataloom.operators import cycles, graph, validate
from strataloom.plans import contracts


def joins_of(df):
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x and "Cross" not in x]


@pytest.fixture
def joins(monkeypatch):
    seen, plain = [], graph.written

    def spy(df, name):
        seen.extend(joins_of(df))
        return plain(df, name)

    for module in (graph, cycles):
        monkeypatch.setattr(module, "written", spy)
    return seen


def peeled(pairs, most=None):
    left = set(pairs)
    while most is None or most > 0:
        kept = {(a, b) for a, b in left if any(a == d for _, d in left) and any(b == c for c, _ in left)}
        if kept == left:
            break
        left, most = kept, None if most is None else most - 1
    return left


@pytest.mark.parametrize("seed,few,most", [(1, 100_000, None), (2, 0, None), (3, 100_000, 2), (4, 0, 3)])
def test_peeling_like_plain_peeling(spark, joins, monkeypatch, seed, few, most):
    monkeypatch.setattr(graph, "PEELED", few)
    r = random.Random(seed)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(44)] + [(100 + i, 101 + i) for i in range(20)]
    got = graph.on_cycles(spark.createDataFrame(pairs, "src long, dst long"), most)
    assert {tuple(x) for x in got.collect()} == peeled(pairs, most)
    assert joins and all("strategy=merge" in x or ("strategy=broadcast" in x and few) for x in joins)


def test_components_and_short_cycles(spark, joins):
    pairs = [(i, (i * 7 + 3) % 50) for i in range(50) if i % 13] + [(i, (i + 16) % 50) for i in range(0, 50, 5)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    strong = cycles.strong_components(e)
    cycle = cycles.short_cycles(e, strong, 6)
    joins += joins_of(strong) + joins_of(cycle)
    assert cycle.count() and joins and all("strategy=" in x for x in joins)


def test_gates(spark):
    """Dispositions and gates name their sides too."""
    folder = "/root/testdata/sf0.001"
    found = joins_of(contracts.recorded(spark, folder)) + joins_of(validate.gates(contracts.nodes(spark, folder), spark.createDataFrame([(2, 0)], "node long, depth int")))
    assert len(found) == 3 and all("strategy=merge" in x for x in found)
