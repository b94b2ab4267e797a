"""Versioned commits: one winner of a race, replays, preconditions, time travel, deletion."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

from strataloom.operators.commits import FIELDS, Conflict, Ontology, VersionedGraph, content_hash
from strataloom.plans import commits as plan

ONTOLOGY = Ontology(("claim", "proof"), (("proves", "proof", "claim"),))


def node(id, type="claim", gone=False, evidence="1", part=None, text="t"):
    return ("node", id, gone, type, part, None, evidence, text)


def edge(id, a, b, type="proves", gone=False):
    return ("edge", id, gone, type, a, b, None, "t")


@pytest.fixture
def store(spark):
    graph = VersionedGraph(spark)
    regions = spark.createDataFrame([(1,), (2,)], "region_id long")

    def commit(name, rows, base, approval=None):
        delta = spark.createDataFrame(rows, FIELDS)
        return graph.commit(name, delta, base, approval or content_hash(delta), ONTOLOGY, regions)

    graph.put = commit
    return graph


def ids(frame):
    return sorted(r.id for r in frame.collect())


def test_versions_replays_and_stale_writers(store):
    assert store.put("a", [node("c"), node("p", "proof"), edge("e", "p", "c")], 0) == 1
    assert store.put("b", [node("c", text="new"), node("x")], 1) == 2
    before = store.heads()
    assert store.put("a", [node("c"), node("p", "proof"), edge("e", "p", "c")], 0) == 1  # a replay
    assert store.heads() == before
    with pytest.raises(Conflict, match="divergent"):
        store.put("a", [node("other")], 2)
    with pytest.raises(Conflict, match="stale"):
        store.put("late", [node("y")], 1)
    with pytest.raises(Conflict, match="approval"):
        store.put("wrong", [node("y")], 2, "no")
    assert store.put("c", [node("x", gone=True)], 2) == 3
    assert ids(store.snapshot()) == ["c", "e", "p"] and ids(store.snapshot(2)) == ["c", "e", "p", "x"] and ids(store.snapshot(1)) == ["c", "e", "p"]
    assert {r.text for r in store.snapshot().filter("id = 'c'").collect()} == {"new"} and {r.text for r in store.snapshot(1).filter("id = 'c'").collect()} == {"t"}


def test_one_of_two_writers_wins(store):
    store.put("a", [node("c")], 0)

    def write(name):
        try:
            return store.put(name, [node(name)], 1)
        except Conflict:
            return None

    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(write, ["left", "right"]))
    assert sorted(map(str, got)) == ["2", "None"] and store.revision() == 2
    assert ids(store.snapshot()) == sorted(["c", "left" if got[0] else "right"])


@pytest.mark.parametrize(
    "rows,code",
    [
        ([node("n", "rumour")], "node type outside"),
        ([node("n", evidence="9")], "unknown evidence"),
        ([node("n", evidence=None)], "without evidence"),
        ([node("n"), node("n")], "repeated object"),
        ([node("gone", gone=True)], "absent object"),
        ([edge("f", "p", "nobody")], "dangling"),
        ([node("p", "proof", gone=True)], "dangling"),
        ([edge("f", "c", "p")], "edge outside"),
    ],
)
def test_preconditions(store, rows, code):
    store.put("a", [node("c"), node("p", "proof"), edge("e", "p", "c")], 0)
    with pytest.raises(Conflict, match=code):
        store.put("b", rows, 1)
    assert store.revision() == 1 and ids(store.snapshot()) == ["c", "e", "p"]


def test_deletion_blocks_or_cascades(spark, store):
    store.put("a", [node("c"), node("p", "proof"), edge("e", "p", "c"), node("part", part="c"), node("deep", part="part"), node("free")], 0)
    asked = spark.createDataFrame([("node", "c"), ("node", "unknown")], "kind string, id string")
    tombs, blockers = store.deletion(asked, cascade=False)
    assert ids(tombs) == ["c"] and sorted((r.id, r.by) for r in blockers.collect()) == [("e", "c"), ("part", "c")]
    tombs, blockers = store.deletion(asked, cascade=True)
    assert ids(tombs) == ["c", "deep", "e", "part"] and blockers.isEmpty()
    store.put("b", [tuple(r) for r in tombs.collect()], 1)
    assert ids(store.snapshot()) == ["free", "p"] and len(ids(store.snapshot(1))) == 6


def test_an_empty_store(store):
    assert store.revision() == 0 and store.snapshot().isEmpty()


def test_attempts_on_the_tables(spark):
    store, ended = plan.history(spark, "/root/testdata/sf0.001")
    ended = dict(ended)
    assert [ended[k] for k in ("first", "update", "replay", "deletion")] == ["revision 1", "revision 2", "revision 2", "revision 3"]
    assert ended["another update by that name"] == "divergent replay" and ended["behind"] == "stale revision" and ended["not approved"] == "approval is for another delta"
    assert ended["faults"].count("'") == 14 and store.revision() == 3
