"""Loops name how their sides are joined: what grows with the input is never left to a broadcast."""

from __future__ import annotations

import pytest

from strataloom.operators import documents, graph, logic

EDGES = [(i, i + 1) for i in range(6)] + [(2, 0), (10, 3)]


@pytest.fixture
def joins(monkeypatch):
    """The joins of all tables that are written, as the optimizer has them."""
    seen, plain = [], graph.written

    def spy(df, name):
        seen.extend(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x)
        return plain(df, name)

    for module in (graph, logic, documents):
        monkeypatch.setattr(module, "written", spy)
    return seen


@pytest.mark.parametrize("few", [0, 10_000])
def test_reach(spark, joins, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    found = graph.reach(spark.createDataFrame(EDGES, "src long, dst long"), spark.createDataFrame([(2,), (2,)], "node long"))
    assert {(r.node, r.depth) for r in found.collect()} == {(2, 0), (3, 1), (0, 1), (4, 2), (1, 2), (5, 3), (6, 4)}
    assert joins and all("strategy=merge" in x or ("strategy=broadcast" in x and few) for x in joins)


def test_closure_and_clean(spark, joins):
    facts = spark.createDataFrame([("D", False, str(a), str(b)) for a, b in EDGES] + [("O", False, "4", None), ("O", False, "1", None)], "pred string, neg boolean, a string, b string")
    rules = [logic.Rule("up", logic.Atom("H", ("X",)), (logic.Atom("D", ("X", "Y")), logic.Atom(p, ("Y",)))) for p in ("O", "H")]
    whole, complete = logic.closure(facts, rules)
    assert complete and {r.a for r in whole.filter("pred = 'H'").collect()} == {"0", "1", "2", "3", "10"}
    clean = logic.clean(facts, facts.filter("a = '4' and pred = 'O'"), logic.supports(whole, rules))
    assert {r.fact for r in clean.filter("fact like 'H%'").collect()} == {"H(0)", "H(1)", "H(2)"}
    assert joins and all("strategy=" in x for x in joins)


def test_fingerprints(spark, joins):
    nodes = spark.createDataFrame([(i, "r", "s") for i in range(7)], "node_id long, role string, status string")
    assert documents.fingerprints(spark.createDataFrame([(a, b) for a, b in EDGES if a < b], "src long, dst long"), nodes).count() == 7
    assert len([x for x in joins if "strategy=" in x]) >= len(joins) - 1  # the filter of dangling edges is made once
