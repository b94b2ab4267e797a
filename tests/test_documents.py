"""Loops to the fixed point, and parsers and folds of documents against plain Python."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pytest
from pyspark.sql import functions as F

from strataloom.operators import documents, graph


def pairs(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def test_long_chains_are_whole(spark):
    n = 66
    e = pairs(spark, [(i, i + 1) for i in range(n)])
    assert graph.reach(e, spark.range(0, 1).withColumnRenamed("id", "node")).agg(F.count(F.lit(1)), F.max("depth")).first() == (n + 1, n)
    assert graph.on_cycles(pairs(spark, [(i, i + 1) for i in range(6)])).count() == 0


def test_endless_loops_are_errors(monkeypatch):
    monkeypatch.setattr(graph, "RUNAWAY", 3)
    with pytest.raises(RuntimeError, match="no fixed point"):
        list(graph.turns(None))
    assert list(graph.turns(2)) == [1, 2]


def test_closure_with_ends(spark):
    e = pairs(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    assert {(r.src, r.dst) for r in graph.closure(e).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)}
    ends = spark.createDataFrame([(4,)], "node long")
    assert {(r.src, r.dst) for r in graph.closure(e, ends).collect()} == {(1, 4), (2, 4), (3, 4)}


@pytest.mark.parametrize(("text", "valid"), [('{"a": [{"b": 1}]}', True), ('{"a": {"b": 1, "b": 2}}', False), ('[1]', False), ('{"a": NaN}', False), ('{"a": [1e999]}', False), ("{", False), (None, False), ("{}", True)])
def test_strict_json(text, valid):
    assert documents.strict(text) is valid


def test_json_leaves():
    assert documents.leaves('{"b": [1, {"c": "x"}, []], "a": null, "d": {}}') == [("a", "null"), ("b.0", "1"), ("b.1.c", '"x"')]
    assert documents.leaves("3") == [("", "3")] and documents.leaves(None) == [] and documents.leaves("[]") == []


def test_html_text():
    page = "<html><head><title>t</title></head><body><h2>Head</h2><nav>no</nav><p>One <a href='/x'>two</a></p><script>no()</script><img alt='pic'></body></html>"
    assert documents.visible_text(page, markdown=False) == "Head One two"
    markdown = documents.visible_text(page, markdown=True)
    assert markdown.startswith("## Head") and "One [two](/x)" in markdown and "![pic]" in markdown and "no" not in markdown
    assert documents.visible_text(None, markdown=True) == ""


def test_chunks_make_the_text(spark):
    text = ("word " * 1000 + "x" * 4000 + " end") * 2
    rows = documents.chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "region_id long, text string")).orderBy("ordinal").collect()
    assert "".join(r.text for r in rows) == text and all(0 < r.end - r.begin <= documents.MOST for r in rows)


def test_formula_spans(spark):
    text = "a $x$ b $$y + z$$ c \\[w\\] d $ 5"
    rows = documents.formula_spans(spark.createDataFrame([(1, text)], "region_id long, text string")).orderBy("begin").collect()
    assert [(text[r.begin : r.end], r.kind) for r in rows] == [("$x$", "inline"), ("$$y + z$$", "display"), ("\\[w\\]", "bracket")]


def test_hash_chain(spark, monkeypatch):
    monkeypatch.setattr(documents, "LINKS", 4)
    rows = [("g", i, f"v{i}") for i in range(70)] + [("h", 3, "x")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def head(of):
        level = {i: sha(v) for i, v in of.items()}
        for _ in range(4):  # 70 orders in blocks of 4: 18, 5, 2 and 1
            blocks: dict[int, str] = {}
            for i in sorted(level):
                blocks[i // 4] = sha(blocks.get(i // 4, "") + level[i])
            level = blocks
        return level[0]

    got = {r.g: r.generation for r in documents.hash_chain(spark.createDataFrame(rows, "g string, o2 long, v string"), "g", "o2", "v").collect()}
    assert got == {"g": head({i: v for g, i, v in rows if g == "g"}), "h": head({3: "x"})}


def test_fingerprints_follow_their_dependencies(spark):
    nodes = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, "c", "s")], "node_id long, role string, status string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    own = {n: sha(f"{n}|{r}|s") for n, r in ((1, "a"), (2, "b"), (3, "c"))}
    two = sha(own[2] + own[3])
    got = {r.node_id: r.print for r in documents.fingerprints(pairs(spark, [(1, 2), (1, 3), (2, 3)]), nodes).collect()}
    assert got == {3: own[3], 2: two, 1: sha(own[1] + "".join(sorted([two, own[3]])))}


def test_cursor_pages(spark):
    rows = spark.createDataFrame([(i, json.dumps("x" * 98)) for i in range(100)], "id long, payload string")
    assert documents.cursor_pages(rows, "id", "payload", 1000).select("page").distinct().count() == 11


def test_hash_chain_of_two_levels(spark, monkeypatch):
    monkeypatch.setattr(documents, "LINKS", 4)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    fold = lambda hashes: reduce(lambda a, x: sha(a + x), hashes, "")
    want = fold([fold([sha(f"v{i}") for i in range(a, min(a + 4, 70))]) for a in range(0, 70, 4)])
    rows = spark.createDataFrame([("g", i, f"v{i}") for i in range(70)], "g string, o2 long, v string")
    assert [r.generation for r in documents.hash_chain(rows, "g", "o2", "v", levels=2).collect()] == [want]
