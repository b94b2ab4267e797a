"""Operators of contracts on hand-made rows."""

from __future__ import annotations

from strataloom.operators import decide, retrieve, validate


def test_information_value_is_gain_less_best_and_cost(spark):
    base = spark.createDataFrame([("a", "x", 5, 1, 1), ("a", "y", 2, 1, 1), ("b", "x", None, 1, 0)], "action string, decision string, eu_num long, den long, cost long")
    seen = spark.createDataFrame([("a", "o1", "x", 1), ("a", "o1", "y", 3), ("a", "o2", "x", 5), ("b", "o1", "x", 9)], "action string, observation string, decision string, eu_num long")
    assert {(r.action, r.value_num, r.den) for r in decide.information_value(base, seen).collect()} == {("a", 8 - 5 - 1, 1), ("b", None, 1)}


def test_winners_keep_ties(spark):
    u = spark.createDataFrame([("a", 1, 2), ("b", 2, 4), ("c", 0, 1), ("d", None, 1)], "action string, eu_num long, den long")
    assert {r.action for r in decide.winners(u).collect()} == {"a", "b"}
    assert decide.winners(u.limit(0)).count() == 0


def test_covering_takes_the_shortest_and_stops_at_a_gap(spark):
    long = [("long", i, i + 1) for i in range(100)]
    c = spark.createDataFrame([("a", 0, 10), ("a", 0, 4), ("a", 4, 9), ("b", 0, 5), ("b", 6, 9), ("c", 0, 30_000), ("d", 0, 0), *long], "key string, begin long, end long")
    n = spark.createDataFrame([("a", 9), ("b", 9), ("c", 30_000), ("d", 0), ("e", 3), ("long", 100)], "key string, length long")
    got = {r.key: (r.slices, r.batches, r.reached, r.status) for r in validate.covering(c, n).collect()}
    assert got == {"a": (2, 1, 9, "complete"), "b": (1, 1, 5, "gap"), "c": (0, 0, 0, "gap"), "d": (0, 0, 0, "complete"), "e": (0, 0, 0, "gap"), "long": (100, 4, 100, "complete")}


def test_continuation_ends_where_an_ordinal_is_missing(spark):
    r = spark.createDataFrame([(i, "s", i) for i in (0, 1, 2, 4, 5)] + [(9, "t", 1)], "region_id long, source_id string, ordinal long")
    got = retrieve.continuation(r.filter("region_id in (0, 4)"), r, 3).collect()
    assert {(x.anchor, x.step, x.region_id) for x in got} == {(0, 1, 1), (0, 2, 2), (4, 1, 5)}


def test_relation_rules_come_before_citations(spark):
    rel = spark.createDataFrame([(1, "analogy", "forward"), (2, "equivalence_candidate", "forward"), (3, "implication", "forward"), (4, "implication", "forward"), (5, "analogy", "neither_established")], "relation_id long, kind string, direction string")
    cite = spark.createDataFrame([(1, 7, "no"), (3, 7, "quick"), (3, 8, "quick"), (4, 7, "quick")], "relation_id long, region long, quotation string")
    texts = spark.createDataFrame([(7, "a quick fox")], "region_id long, text string")
    got = {r.relation_id: (r.citations, r.issue) for r in validate.relation_issues(rel, cite, texts).collect()}
    assert got == {1: (1, "analogy_direction"), 2: (0, "equivalence_direction"), 3: (2, "citation_absent"), 4: (1, "ok"), 5: (0, "not_attributed")}


def test_merged_nodes_remap_their_edges(spark):
    n = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None)], "node_id long, status string")
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4)], "src long, dst long")
    m = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "node long, canonical long")
    got = {tuple(r) for r in validate.merged_nodes(n, e, m, "status").select("canonical", "members", "status", "parents").collect()}
    assert got == {(1, 2, "x,y", 1), (3, 1, "x", 1), (4, 1, "", 0)}


def test_delta_of_an_extraction(spark):
    raw = spark.createDataFrame([("d", '{"components":["p","p"],"obligations":["o"],"relations":[{"subject_id":"p","predicate":"requires","object_id":"o"},{"subject_id":"p","predicate":"requires","object_id":"z"}]}'), ("e", None), ("f", "{}")], "object_id string, json string")
    allowed = spark.createDataFrame([("requires", "component", "obligation")], "relation string, src_type string, dst_type string")
    got = {tuple(r) for r in validate.extraction_delta(raw, allowed).select("action", "id", "type", "target", "issue").collect()}
    assert got == {("upsert_node", "p", "component", None, "ok"), ("upsert_node", "o", "obligation", None, "ok"), ("add_edge", "p", "requires", "o", "ok"), ("add_edge", "p", "requires", "z", "missing_target")}


def test_coverage_and_gates(spark):
    found = spark.createDataFrame([("g", "a"), ("g", "a"), ("h", "b"), ("h", "a")], "group string, type string")
    need = spark.createDataFrame([("a",), ("b",), ("b",)], "type string")
    assert {(r.group, r.types, r.missing, r.lacks) for r in validate.coverage(found, need).collect()} == {("g", 1, 1, "b"), ("h", 2, 0, "")}
    nodes = spark.createDataFrame([(1, "statement", "supported"), (2, "obligation", "verified"), (3, "obligation", "failed")], "node_id long, role string, status string")
    reached = spark.createDataFrame([(1, 0), (2, 1)], "node long, depth int")
    got = {r.gate: r.blocking for r in validate.gates(nodes, reached).collect()}
    assert got == {"target_is_claim": 0, "nothing_refuted": 0, "has_obligation": 0, "obligations_reached": 1, "obligations_resolved": 1}
