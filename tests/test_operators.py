"""Graph, logic, decision and validation operators against plain Python on small inputs."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from strataloom.operators import decide, graph, logic, retrieve, validate
from strataloom.operators.logic import Atom, Rule


def edge_table(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_reach_has_least_depths_and_ends_on_cycles(spark):
    rows = graph.reach(edge_table(spark, [(1, 2), (2, 3), (3, 1), (1, 3), (4, 5)]), spark.createDataFrame([(1,)], "node long")).collect()
    assert {(r.node, r.depth) for r in rows} == {(1, 0), (2, 1), (3, 1)}


def test_components_match_union_find(spark):
    random.seed(5)
    pairs = [(random.randrange(60), random.randrange(60)) for _ in range(45)]
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in pairs:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {n: find(n) for u, v in pairs if u != v for n in (u, v)}


def test_components_of_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_paths_and_cycles(spark):
    found = graph.paths(edge_table(spark, [(1, 2), (2, 1), (2, 3)]), spark.createDataFrame([(1,)], "node long"), 4)
    assert {(tuple(r.path), r.end) for r in found.collect()} == {((1, 2, 1), "cycle"), ((1, 2, 3), "leaf")}
    assert [r.cycle for r in graph.cycle_witness(found).collect()] == [[1, 2]]


def test_levels_are_longest_paths(spark):
    e = edge_table(spark, [(1, 2), (2, 3), (1, 3)])
    assert {(r.node, r.level) for r in graph.levels(e, spark.createDataFrame([(1,), (2,), (3,)], "node long")).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_closure_supports_and_taint(spark):
    facts = spark.createDataFrame([("E", False, "a", "b"), ("E", False, "b", "c"), ("Bad", False, "c", None), ("P", False, "x", "x"), ("P", False, "x", "y")], "pred string, neg boolean, a string, b string")
    rules = [Rule("base", Atom("R", ("X", "Y")), (Atom("E", ("X", "Y")),)), Rule("step", Atom("R", ("X", "Z")), (Atom("E", ("X", "Y")), Atom("R", ("Y", "Z")))), Rule("loop", Atom("L", ("X",)), (Atom("P", ("X", "X")),))]
    found, complete = logic.closure(facts, rules)
    assert complete
    assert {(r.pred, r.a, r.b) for r in found.filter("round > 0").collect()} == {("R", "a", "b"), ("R", "b", "c"), ("R", "a", "c"), ("L", "x", None)}
    sup = logic.supports(found, rules)
    assert sup.count() == 4
    kept = {r.fact for r in logic.clean(facts, facts.filter("pred = 'E' and a = 'b'"), sup).collect()}
    assert "R(a,b)" in kept and "R(a,c)" not in kept and "R(b,c)" not in kept
    assert not logic.closure(facts, rules, most=1)[1]


def test_join_matches_brute_force(spark):
    rows = [(f"n{i}", f"n{j}") for i, j in itertools.product(range(6), range(4)) if (i * j) % 3]
    facts = spark.createDataFrame([("E", False, a, b) for a, b in rows], "pred string, neg boolean, a string, b string")
    rule = Rule("two", Atom("T", ("X", "Z")), (Atom("E", ("X", "Y")), Atom("E", ("Y", "Z"))))
    assert logic.derive(rule, facts).count() == sum(1 for a, b in rows for c, d in rows if b == c)


def test_first_fit_skips_and_goes_on(spark):
    df = spark.createDataFrame([("g", 1, 50), ("g", 2, 80), ("g", 3, 40)], "k string, item long, size long")
    assert {r.item for r in retrieve.first_fit(df, "k", "size", 100, [F.col("item")]).collect()} == {1, 3}


def test_overlaps_match_brute_force(spark):
    random.seed(2)
    left = [(i, a := random.randrange(500), a + random.randrange(120)) for i in range(40)]
    right = [(i, a := random.randrange(500), a + random.randrange(120)) for i in range(40)]
    table = lambda rows, p: spark.createDataFrame([("g", *r) for r in rows], f"group string, {p}_id long, {p}_begin long, {p}_end long")
    got = sorted((r.l_id, r.r_id) for r in validate.overlaps(table(left, "l"), table(right, "r"), 64).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2])


def test_unknown_utility_is_unknown(spark):
    rows = [("a", 1, 1, 2, 6, 0), ("a", 2, 1, 2, 2, 0), ("b", 1, 1, 1, None, 0)]
    got = {r.action: r.eu_num for r in decide.expected_utility(spark.createDataFrame(rows, "action string, outcome long, num long, den long, utility long, cost long")).collect()}
    assert got == {"a": 8, "b": None}


def test_formulas_and_citations_anywhere_in_a_text(spark, tmp_path):
    from strataloom import catalog

    long = "plain words " * 40
    docs = [(1, long + "$e=mc^2$ then " + long, "en", "a"), (2, long, "en", "a")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    turns = [(1, 0, "user", long + "as [S7] says " + long), (1, 1, "user", long)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalog.queries()["s15_formula_spans"](spark, str(tmp_path)).collect()
    n = len(long)
    assert (1, n, n + 8, "inline") in {tuple(r) for r in got}
    assert sorted(r.kind for r in got if r.region_id == 2) == ["bracket", "display", "inline"]
    cited = {r.turn: (r.cited, r.unknown) for r in catalog.queries()["c27_citations"](spark, str(tmp_path)).collect()}
    assert cited == {0: ("S7,S1,G0", "S7"), 1: ("S1,G1", "G1")}


def test_first_fit_streams_and_copies_are_not_paired(spark, tmp_path):
    from strataloom import catalog

    rows = [(k, i, (i * 7 + k) % 40) for k in (1, 2, 3) for i in range(500)] + [(4, 0, None), (4, 1, 999), (None, 5, 7)]
    want = set()
    for k in (1, 2, 3, 4, None):
        used, taken = 0, []
        for _, i, n in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1]):
            if n is not None and used + n <= 300:
                used += n
                taken.append(i)
        want |= {(k, used, i) for i in taken}
    fit = retrieve.first_fit(spark.createDataFrame(rows, "k long, item long, size long").repartition(3), "k", "size", 300, [-F.col("item")])
    assert {tuple(r) for r in fit.collect()} == want
    assert "collect_list" not in fit._jdf.queryExecution().toString()
    spark.createDataFrame([(i, "Same  text" if i % 2 else "same text ", "en", "a") for i in range(300)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    j11 = catalog.queries()["j11_exact_statement_dup"](spark, str(tmp_path))
    assert {tuple(r) for r in j11.collect()} == {(i, 0) for i in range(1, 300)}
    assert "(region_id#" not in "".join(x for x in j11._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)
