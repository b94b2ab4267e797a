"""Queries of the reasoner over the part graph's recorded edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logic as op
from ..operators.graph import disposition
from ..operators.logic import Atom, Rule
from ..sources.tables import edges, nodes, sql
from .graph import DISPOSED

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, run, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle


#: What follows for a node from what it depends on.
OPEN = [Rule("open", Atom("HasOpen", ("X",)), (Atom("Depends", ("X", "Y")), Atom("Open", ("Y",)))), Rule("open-up", Atom("HasOpen", ("X",)), (Atom("Depends", ("X", "Y")), Atom("HasOpen", ("Y",))))]
PROBLEM = [Rule("problem", Atom("HasProblem", ("X",)), (Atom("Depends", ("X", "Y")), Atom("Problem", ("Y",)))), Rule("problem-up", Atom("HasProblem", ("X",)), (Atom("Depends", ("X", "Y")), Atom("HasProblem", ("Y",))))]
TWO_STEP = Rule("two", Atom("Second", ("X", "Z")), (Atom("Depends", ("X", "Y")), Atom("Depends", ("Y", "Z"))))
BLOCKED = [Rule("not-open", Atom("Sound", ("X",), True), (Atom("HasOpen", ("X",)),)), Rule("sound", Atom("Sound", ("X",)), (Atom("Verified", ("X",)),))]


def facts(s, d):
    """Node and dependency facts of the snapshot."""
    n, e = nodes(s, d), disposition(edges(s, d), nodes(s, d)).filter("disposition = 'recorded'")
    none = F.lit(None).cast("string")
    node = lambda pred, where: n.filter(where).select(F.lit(pred).alias("pred"), F.lit(False).alias("neg"), F.col("node_id").cast("string").alias("a"), none.alias("b"))
    return (
        node("Open", "role = 'obligation' and status not in ('verified', 'supported')")
        .unionByName(node("Problem", "status in ('refuted', 'failed', 'contradicted')"))
        .unionByName(node("Verified", "status = 'verified'"))
        .unionByName(e.select(F.lit("Depends").alias("pred"), F.lit(False).alias("neg"), F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b")))
    )


FACTS = DISPOSED + """, dep as (select src::varchar as a, dst::varchar as b from disposed where disposition = 'recorded'),
facts as (select 'Open' as pred, false as neg, node_id::varchar as a, cast(null as varchar) as b from nodes where role = 'obligation' and status not in ('verified', 'supported')
  union all select 'Problem', false, node_id::varchar, null from nodes where status in ('refuted', 'failed', 'contradicted')
  union all select 'Verified', false, node_id::varchar, null from nodes where status = 'verified' union all select 'Depends', false, a, b from dep)"""
HAS = "{name} as (select dep.a from dep join facts f on f.pred = '{pred}' and f.a = dep.b union select dep.a from dep join {name} h on h.a = dep.b)"
HAS_OPEN, HAS_PROBLEM = HAS.format(name="has_open", pred="Open"), HAS.format(name="has_problem", pred="Problem")


def closed(s, d, rules):
    return op.closure(facts(s, d), rules)[0]


query("l09_snapshot_facts", facts, sql(f"with {FACTS} select * from facts", "nodes", "edges"))
query("j01_rule_join", lambda s, d: op.derive(TWO_STEP, facts(s, d)).select("a", "b", F.array_join("premises", " ").alias("premises")), sql(f"with {FACTS} select x.a, y.b, 'Depends(' || x.a || ',' || x.b || ') Depends(' || y.a || ',' || y.b || ')' as premises from dep x join dep y on x.b = y.a", "nodes", "edges"))
query("l01_horn_closure", lambda s, d: closed(s, d, OPEN).select(*op.FACT), sql(f"with {FACTS}, {HAS_OPEN} select * from facts union all select 'HasOpen', false, a, null from has_open", "nodes", "edges", recursive=True))
query("l02_graph_rules", lambda s, d: closed(s, d, OPEN + PROBLEM).filter("pred like 'Has%'").select("pred", "a"), sql(f"with {FACTS}, {HAS_OPEN}, {HAS_PROBLEM} select 'HasOpen' as pred, a from has_open union all select 'HasProblem', a from has_problem", "nodes", "edges", recursive=True))
query("l03_supports", lambda s, d: op.supports(closed(s, d, OPEN), OPEN).select("rule", "a", F.array_join("premises", " ").alias("premises")), sql(f"with {FACTS}, {HAS_OPEN} select 'open' as rule, dep.a, 'Depends(' || dep.a || ',' || dep.b || ') Open(' || dep.b || ')' as premises from dep join facts f on f.pred = 'Open' and f.a = dep.b union all select 'open-up', dep.a, 'Depends(' || dep.a || ',' || dep.b || ') HasOpen(' || dep.b || ')' from dep join has_open h on h.a = dep.b", "nodes", "edges", recursive=True))
query("l04_explicit_contradiction", lambda s, d: op.contradictions(closed(s, d, OPEN + BLOCKED)).select("pred", "neg", "a"), sql(f"with {FACTS}, {HAS_OPEN}, c as (select a from has_open intersect select a from facts where pred = 'Verified') select 'Sound' as pred, unnest([true, false]) as neg, a from c", "nodes", "edges", recursive=True))


def tainted(s, d):
    given, rules = facts(s, d), OPEN
    whole = closed(s, d, rules)
    blocked = given.filter("pred = 'Open' and cast(a as bigint) % 3 = 0")
    return op.clean(given, blocked, op.supports(whole, rules))


query("l05_taint_fixpoint", lambda s, d: tainted(s, d).filter("fact like 'HasOpen%'"), sql(f"with {FACTS}, ok as (select * from facts where not (pred = 'Open' and a::bigint % 3 = 0)), h as (select dep.a from dep join ok on ok.pred = 'Open' and ok.a = dep.b union select dep.a from dep join h on h.a = dep.b) select 'HasOpen(' || a || ')' as fact from h", "nodes", "edges", recursive=True))


def incomplete(s, d):
    found, complete = op.closure(facts(s, d), OPEN, most=3)
    return found.filter("pred = 'HasOpen'").select("a", F.lit(not complete).alias("blocked"))


query("l06_incomplete_blocks_all", incomplete, sql(f"with {FACTS}, h as (select dep.a, 1 as n from dep join facts f on f.pred = 'Open' and f.a = dep.b union select dep.a, n + 1 from dep join h on h.a = dep.b where n < 3) select distinct a, true as blocked from h", "nodes", "edges", recursive=True))


def unmatched(s, d):
    rules = OPEN + PROBLEM + [Rule("never", Atom("N", ("X",)), (Atom("Missing", ("X",)),))]
    fired = op.supports(closed(s, d, OPEN), rules).select("rule").distinct()
    return s.createDataFrame([(r.name,) for r in rules], "rule string").join(fired, "rule", "left_anti")


FIRED = """fired as (select 'open' as rule from dep join facts f on f.pred = 'Open' and f.a = dep.b union select 'open-up' from dep join has_open h on h.a = dep.b
  union select 'problem' from dep join facts f on f.pred = 'Problem' and f.a = dep.b union select 'problem-up' from dep join facts f on f.pred = 'HasProblem' and f.a = dep.b union select 'never' from facts where pred = 'Missing')"""
query("l07_unmatched_rules", unmatched, sql(f"with {FACTS}, {HAS_OPEN}, {FIRED} select rule from (select unnest(['open', 'open-up', 'problem', 'problem-up', 'never']) as rule) where rule not in (select rule from fired)", "nodes", "edges", recursive=True))
query("l08_hypothesis_dependencies", lambda s, d: (lambda sup: sup.select("a", F.explode("premises").alias("premise")).filter("premise like 'Open(%'").withColumn("proposed", F.regexp_extract("premise", r"\((\d+)", 1).cast("long") % 2 == 0).groupBy("a").agg(F.bool_or("proposed").alias("conditional")))(op.supports(facts(s, d), OPEN[:1])), sql(f"with {FACTS} select dep.a, bool_or(dep.b::bigint % 2 = 0) as conditional from dep join facts f on f.pred = 'Open' and f.a = dep.b group by dep.a", "nodes", "edges"))
query("l12_assess_claim", lambda s, d: (lambda x: x.groupBy("src").agg(F.bool_or(F.col("status").isin("refuted", "failed")).alias("r"), F.bool_and(F.col("status").isin("verified", "supported")).alias("v"), F.bool_or(F.col("status") == "unresolved").alias("u")).select("src", F.when(F.col("r"), "refuted").when(F.col("v"), "verified").when(F.col("u"), "not_established").otherwise("conditional").alias("assessment")))(edges(s, d).select("src", "dst").join(nodes(s, d), F.col("dst") == F.col("node_id"))), sql("select src, case when bool_or(n.status in ('refuted', 'failed')) then 'refuted' when bool_and(n.status in ('verified', 'supported')) then 'verified' when bool_or(n.status = 'unresolved') then 'not_established' else 'conditional' end as assessment from edges e join nodes n on dst = node_id group by src", "nodes", "edges"))
query("l13_obligation_status_rules", lambda s, d: op.derive(Rule("open", Atom("NotEstablished", ("X",)), (Atom("Depends", ("X", "Y")), Atom("Open", ("Y",)))), facts(s, d)).select("a").distinct(), sql(f"with {FACTS} select distinct dep.a from dep join facts f on f.pred = 'Open' and f.a = dep.b", "nodes", "edges"))
query("f09_strict_graph", lambda s, d: edges(s, d).withColumn("origin", F.when(F.col("status") == "proposed", "proposed").otherwise("assumed")).select("src", "dst", "origin", F.sha2(F.concat_ws("|", "src", "dst", F.lit("assumed")), 256).alias("hypothesis_id")), sql("select src, dst, case when status = 'proposed' then 'proposed' else 'assumed' end as origin, sha256(src || '|' || dst || '|assumed') as hypothesis_id from edges", "edges"))
query("q03_analyze_graph", lambda s, d: closed(s, d, OPEN + PROBLEM).groupBy("pred").agg(F.count(F.lit(1)).alias("n")), sql(f"with {FACTS}, {HAS_OPEN}, {HAS_PROBLEM}, u as (select pred from facts union all select 'HasOpen' from has_open union all select 'HasProblem' from has_problem) select pred, count(*) as n from u group by pred", "nodes", "edges", recursive=True))
