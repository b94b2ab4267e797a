"""Commits, checks and deletions on a versioned graph that is built from the part graph.

The driver's tables hold no deltas, so they are planted: a first commit of all nodes and edges, an update
(every 17th node changes, edges of every 29th go), a deletion with all that depends on it, and between them
deltas that mustn't go through. A node whose number ends in 7 or 8 is a part of the one before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.commits import COLUMNS, Conflict, Ontology, VersionedGraph, content_hash
from ..sources.shared import written
from ..sources.tables import edges, nodes, regions, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
ONTOLOGY = Ontology(("statement", "obligation"), tuple(("requires", a, b) for a in ("statement", "obligation") for b in ("statement", "obligation")))


def query(name: str, run, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle


def objects(s, d) -> DataFrame:
    """All nodes and edges as rows of a delta."""
    text = lambda value: F.lit(value).cast("string")
    count = regions(s, d).agg(F.count(F.lit(1)).alias("n"))  # one row
    part = F.when((F.col("node_id") % 10).isin(7, 8), F.concat(F.lit("n"), F.col("node_id") - 1))
    n = nodes(s, d).crossJoin(count).select(
        F.lit("node").alias("kind"), F.concat(F.lit("n"), "node_id").alias("id"), F.lit(False).alias("gone"), F.col("role").alias("type"),
        part.alias("source"), text(None).alias("target"), (F.col("node_id") % F.col("n")).cast("string").alias("evidence"), text("first").alias("text"),
    )
    e = edges(s, d).select(
        F.lit("edge").alias("kind"), F.concat_ws("-", F.lit("e"), "src", "dst").alias("id"), F.lit(False).alias("gone"), text("requires").alias("type"),
        F.concat(F.lit("n"), "src").alias("source"), F.concat(F.lit("n"), "dst").alias("target"), text(None).alias("evidence"), F.col("status").alias("text"),
    )
    return n.unionByName(e)


def number(of: str = "id"):
    return F.regexp_extract(of, r"^n(\d+)$", 1).cast("long")


def update(graph: DataFrame) -> DataFrame:
    changed = graph.filter((F.col("kind") == "node") & (number() % 17 == 0)).withColumn("text", F.lit("second"))
    gone = graph.filter((F.col("kind") == "edge") & (number("source") % 29 == 0)).withColumn("gone", F.lit(True))
    return changed.unionByName(gone).select(*COLUMNS)


def doomed(graph: DataFrame) -> DataFrame:
    return graph.filter((F.col("kind") == "node") & (number() % 97 == 6)).select("kind", "id")


def faulty(graph: DataFrame) -> DataFrame:
    """A delta with every fault that is looked for."""
    node = graph.filter("kind = 'node'")
    return reduce(DataFrame.unionByName, [
        node.filter(number() % 53 == 1).withColumn("gone", F.lit(True)),  # their edges dangle
        node.filter(number() % 53 == 2).withColumn("type", F.lit("rumour")),
        node.filter(number() % 53 == 3).withColumn("evidence", F.lit("nowhere")),
        node.filter(number() % 53 == 4).withColumn("evidence", F.lit(None).cast("string")),
        node.filter(number() % 53 == 5).withColumns({"id": F.concat(F.lit("absent-"), "id"), "gone": F.lit(True)}),
        node.filter(number() % 53 == 6).unionByName(node.filter(number() % 53 == 6)),
        graph.filter((F.col("kind") == "edge") & (number("source") % 53 == 7)).withColumn("type", F.lit("likes")),
    ]).select(*COLUMNS)


def history(s, d) -> tuple[VersionedGraph, list[tuple[str, str]]]:
    """The graph after all that is tried on it, and how each attempt ended."""
    store, known = VersionedGraph(s), regions(s, d)
    graph = written(objects(s, d), "objects")
    ended: list[tuple[str, str]] = []

    def attempt(step: str, name: str, delta: DataFrame, base: int, approval: str | None = None) -> None:
        try:
            ended.append((step, f"revision {store.commit(name, delta, base, approval or content_hash(delta), ONTOLOGY, known)}"))
        except Conflict as e:
            ended.append((step, str(e)))

    change = written(update(graph), "update")
    attempt("first", "first", graph, 0)
    attempt("update", "update", change, 1)
    attempt("replay", "update", change, 1)
    attempt("another update by that name", "update", change.limit(1), 2)
    attempt("behind", "behind", doomed_rows(graph), 1)
    attempt("not approved", "not approved", doomed_rows(graph), 2, "approval of something else")
    attempt("faults", "faults", faulty(graph), 2)
    gone, blockers = store.deletion(doomed(graph), cascade=True)
    attempt("deletion", "deletion", written(gone, "tombstones"), 2)
    return store, ended


def doomed_rows(graph: DataFrame) -> DataFrame:
    return graph.join(doomed(graph), ["kind", "id"], "left_semi").withColumn("gone", F.lit(True)).select(*COLUMNS)


def revisions(s, d):
    store, _ = history(s, d)
    each = [store.snapshot(at).groupBy("kind", "type", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("revision", F.lit(at).cast("long")) for at in range(1, store.revision() + 1)]
    return reduce(DataFrame.unionByName, each)


OBJECTS = """o as (select 'node' as kind, 'n' || node_id as id, node_id as number, role as type, case when node_id % 10 in (7, 8) then 'n' || (node_id - 1) end as source, null::varchar as target,
    (node_id % (select count(*) from documents))::varchar as evidence, 'first' as text from nodes
  union all select 'edge', 'e-' || src || '-' || dst, src, 'requires', 'n' || src, 'n' || dst, null::varchar, status from edges)"""
FALL = """fall as (select kind, id from o where kind = 'node' and number % 97 = 6 union select o.kind, o.id from o join fall f on f.kind = 'node' and (o.source = f.id or o.target = f.id))"""
query("t03_atomic_commits", revisions, sql(f"""with {OBJECTS}, {FALL}, second as (select kind, id, type, case when kind = 'node' and number % 17 = 0 then 'second' else text end as text from o where kind = 'node' or number % 29 <> 0),
    each as (select 1::bigint as revision, kind, id, type, text from o union all select 2, kind, id, type, text from second union all select 3, kind, id, type, text from second where (kind, id) not in (select kind, id from fall))
    select revision, kind, type, text, count(*) as n from each group by all""", "nodes", "edges", recursive=True))


def first_store(s, d) -> tuple[VersionedGraph, DataFrame]:
    store, graph = VersionedGraph(s), written(objects(s, d), "objects")
    store.commit("first", graph, 0, content_hash(graph), ONTOLOGY, regions(s, d))
    return store, graph


def prepared(s, d):
    store, graph = first_store(s, d)
    return store.issues(written(faulty(graph), "faulty"), ONTOLOGY, regions(s, d))


query("t05_prepare_issues", prepared, sql(f"""with {OBJECTS}, n as (select * from o where kind = 'node'), e as (select * from o where kind = 'edge'),
    ended as (select e.*, (select number % 53 from n where n.id = e.source) as a, (select number % 53 from n where n.id = e.target) as b from e)
    select 'node type outside the ontology' as code, kind, id from n where number % 53 = 2
    union all select 'unknown evidence', kind, id from n where number % 53 = 3 union all select 'node without evidence', kind, id from n where number % 53 = 4
    union all select 'removal of an absent object', kind, 'absent-' || id from n where number % 53 = 5 union all select 'repeated object', kind, id from n where number % 53 = 6
    union all select 'dangling edge', kind, id from ended where a is null or b is null or a = 1 or b = 1
    union all select 'edge outside the ontology', kind, id from ended where coalesce(a, 1) <> 1 and coalesce(b, 1) <> 1 and (a = 2 or b = 2 or a = 7)""", "nodes", "edges"))


def deleted(s, d):
    """What falls with the deleted nodes, and what would block their deletion alone."""
    store, graph = first_store(s, d)
    fall, _ = store.deletion(doomed(graph), cascade=True)
    _, blockers = store.deletion(doomed(graph), cascade=False)
    out = fall.select(F.lit("falls").alias("what"), "kind", "id", F.lit(None).cast("string").alias("by"))
    return out.unionByName(blockers.select(F.lit("blocks").alias("what"), "kind", "id", "by"))


query("t09_delete_cascade", deleted, sql(f"""with {OBJECTS}, {FALL}, g as (select id from o where kind = 'node' and number % 97 = 6)
    select 'falls' as what, kind, id, null::varchar as by from fall
    union select 'blocks', o.kind, o.id, g.id from o join g on o.source = g.id or o.target = g.id where o.kind = 'edge' or o.id not in (select id from g)""", "nodes", "edges", recursive=True))
