"""Composite queries: retrieval, tracing, consolidation, commits and registries built from the operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exact
from ..functions import text as fn
from ..operators import cycles, documents, graph, logic, retrieve, store, validate
from ..operators.logic import Atom, Rule
from ..sources.shared import written
from ..sources.tables import edges, graded_regions, history, nodes, ordered_regions, records, regions, sql, table, vectors
from .checks import CODES, REFS, references
from .graph import DAG, DISPOSED, order_dag, recorded, root
from .logic import FACTS, facts
from .retrieval import VEC, first_vector
from .store import K_SQL, half, k

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, run, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle


#: The part graph without its supported edges.
WEAK = "weak as (select src, dst from edges where status <> 'supported'), cl as (select src, dst from weak union select cl.src, weak.dst from cl join weak on cl.dst = weak.src)"


def weak(s, d):
    return edges(s, d).filter("status <> 'supported'").select("src", "dst")


query("g15_circular_support", lambda s, d: cycles.strong_components(weak(s, d)).select(F.col("node").alias("src")), sql(f"with {WEAK} select src from cl where src = dst", "edges", recursive=True))


def open_roots(s, d):
    """The obligations that each node's weak edges lead to: worked out for components, then handed to their nodes."""
    e = weak(s, d)
    strong = written(cycles.strong_components(e), "strong")
    placed = nodes(s, d).join(strong, F.col("node_id") == F.col("node"), "left").select("node_id", "role", F.coalesce("scc", "node_id").alias("part"), F.col("scc").isNotNull().alias("cyclic"))
    placed = written(placed, "placed")
    wanted = placed.filter("role = 'obligation'")
    ahead = graph.closure(cycles.condensed(e, strong), wanted.select(F.col("part").alias("node")))
    reached = ahead.select(F.col("src").alias("from"), F.col("dst").alias("part")).unionByName(placed.filter("cyclic").select(F.col("part").alias("from"), "part").distinct())
    roots = reached.join(wanted.select("part", F.col("node_id").alias("open")), "part").groupBy("from").agg(F.array_join(F.array_sort(F.collect_set("open")), ",").alias("roots"))
    return placed.join(roots, F.col("part") == F.col("from")).select(F.col("node_id").alias("src"), "roots")


query(
    "g16_open_roots",
    open_roots,
    sql(f"with {WEAK} select src, string_agg(dst::varchar, ',' order by dst) as roots from cl where dst in (select node_id from nodes where role = 'obligation') group by src", "nodes", "edges", recursive=True),
)
#: What is open, blocked and evidenced follows along dependencies; both sides of a conflict are blocked.
ATTEMPT = [
    Rule("unresolved", Atom("Open", ("X",)), (Atom("Depends", ("X", "Y")), Atom("Open", ("Y",)))),
    Rule("blocked", Atom("Blocked", ("X",)), (Atom("Depends", ("X", "Y")), Atom("Blocked", ("Y",)))),
    Rule("evidence", Atom("EvidencePresent", ("X",)), (Atom("Verified", ("X",)),)),
    Rule("conflict-source", Atom("Blocked", ("X",)), (Atom("Contradicts", ("X", "Y")),)),
    Rule("conflict-target", Atom("Blocked", ("Y",)), (Atom("Contradicts", ("X", "Y")),)),
]


def attempt_states(s, d):
    """The states of nodes whose refuted edges are conflicts."""
    conflicts = edges(s, d).filter("status = 'refuted'").select(F.lit("Contradicts").alias("pred"), F.lit(False).alias("neg"), F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"))
    found, _ = logic.closure(facts(s, d).unionByName(conflicts), ATTEMPT)
    return found.filter(F.col("pred").isin("Open", "Blocked", "EvidencePresent")).select("pred", "a")


query(
    "l10_attempt_state_rules",
    attempt_states,
    sql(f"""with {FACTS}, x as (select src::varchar as a, dst::varchar as b from edges where status = 'refuted'),
        op as (select a from facts where pred = 'Open' union select dep.a from dep join op on op.a = dep.b),
        bl as (select unnest([a, b]) as a from x union select dep.a from dep join bl on bl.a = dep.b)
      select 'Open' as pred, a from op union all select distinct 'Blocked', a from bl union all select 'EvidencePresent', a from facts where pred = 'Verified'""", "nodes", "edges", recursive=True),
)
query("l11_facet_preservation", lambda s, d: (lambda n: edges(s, d).select("src", "dst").join(n.select(F.col("node_id").alias("src"), F.col("facet").alias("l")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("facet").alias("r")), "dst").filter("l is null or r is null or not (l <=> r)").select("src", "dst"))(nodes(s, d).withColumn("facet", F.when(F.col("status") != "proposed", F.col("role")))), sql("with n as (select node_id, case when status <> 'proposed' then role end as facet from nodes) select src, dst from edges join n a on a.node_id = src join n b on b.node_id = dst where a.facet is null or b.facet is null or a.facet <> b.facet", "nodes", "edges"))
query("v05_structural_contract", lambda s, d: (lambda n, e: n.filter("role = 'obligation'").join(e.select(F.col("src").alias("node_id")), "node_id", "left_anti").select("node_id", F.lit("no_dependency").alias("issue")).unionByName(n.filter("status = 'contradicted'").join(e.select(F.col("dst").alias("node_id")), "node_id", "left_semi").select("node_id", F.lit("used_though_contradicted").alias("issue"))))(nodes(s, d), edges(s, d)), sql("select node_id, 'no_dependency' as issue from nodes where role = 'obligation' and node_id not in (select src from edges) union all select node_id, 'used_though_contradicted' from nodes where status = 'contradicted' and node_id in (select dst from edges)", "nodes", "edges"))
query("v07_delta_integrity", lambda s, d: (lambda up, rm: up.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("repeated").alias("issue")).unionByName(up.join(rm, "id", "left_semi").distinct().select("id", F.lit("upserted_and_removed").alias("issue"))))(records(s, d).filter("kind = 'view'").select(k().alias("id")), records(s, d).filter("kind = 'error' and id % 40 = 0").select(k().alias("id")).distinct()), sql(f"with up as (select {K_SQL} as id from records where kind = 'view'), rm as (select distinct {K_SQL} as id from records where kind = 'error' and id % 40 = 0) select id, 'repeated' as issue from up group by id having count(*) > 1 union all select distinct id, 'upserted_and_removed' from up where id in (select id from rm)", "records"))
NORMAL = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
ALIASES = f"al as (select * from (select region_id as u, unnest(list_distinct([{NORMAL.format('text')}, {NORMAL.format('string_split(text, chr(10))[1]')}, {NORMAL.format('string_split(text, chr(10))[-1]')}])) as alias from regions) where len(string_split(alias, ' ')) >= 4), ln as (select distinct a.u, b.m as v from al a join (select alias, min(u) as m from al group by alias) b using (alias) where a.u <> b.m), bi as (select u, v from ln union select v, u from ln), cc as (select region_id as node, region_id as root from regions union select v, root from cc join bi on u = node)"


def alias_classes(s, d):
    """Regions that share an alias (their whole text, first or last line, of 4 words or more), linked through its least region."""
    lines = F.split("text", "\n")
    aliases = F.transform(F.array(F.col("text"), F.element_at(lines, 1), F.element_at(lines, -1)), fn.normal_statement)
    long = F.filter(F.array_distinct(aliases), lambda x: F.size(F.split(x, " ")) >= 4)
    a = regions(s, d).select(F.col("region_id").alias("u"), F.explode(F.transform(long, lambda x: F.unhex(F.sha2(x, 256)))).alias("alias"))
    links = a.join(a.groupBy("alias").agg(F.min("u").alias("v")), "alias").filter("u <> v").select("u", "v")
    roots = graph.components(links)
    return regions(s, d).select("region_id", "source_id").join(roots, F.col("region_id") == F.col("node"), "left").select("region_id", "source_id", F.coalesce("root", "region_id").alias("root"))


query("j10_alias_overlap", lambda s, d: alias_classes(s, d).select("region_id", "root"), sql(f"with {ALIASES} select node as region_id, min(root) as root from cc group by node", "regions", recursive=True))
query(
    "k08_projection_pick",
    lambda s, d: records(s, d).filter((F.col("kind") == "view") & (F.col("seq") > half(s, d))).groupBy("corpus_id").agg(F.min("id").alias("projection")),
    sql("select corpus_id, min(id) as projection from records where kind = 'view' and seq > (select max(seq) // 2 from records) group by corpus_id", "records"),
)
query("f07_validate_manifest", lambda s, d: records(s, d).select("id", F.regexp_replace("payload", "k", F.element_at(F.array(F.lit("k"), F.lit("api_key"), F.lit("x_token"), F.lit("n")), (F.col("id") % 4 + 1).cast("int"))).alias("m")).select("id", F.col("m").rlike(r'(?i)"[^"]*(password|secret|token|api_?key)[^"]*"\s*:').alias("rejected")), sql("select id, id % 4 in (1, 2) as rejected from records", "records"))
query("c01_canonical_json", lambda s, d: table(s, d, "nation").select(F.to_json(F.struct("n_name", "n_nationkey", F.lit(None).cast("string").alias("note"), "n_regionkey"), {"ignoreNullFields": "false"}).alias("json")), "select '{\"n_name\":' || to_json(n_name) || ',\"n_nationkey\":' || n_nationkey || ',\"note\":null,\"n_regionkey\":' || n_regionkey || '}' as json from nation")
query("c02_identity", lambda s, d: table(s, d, "nation").select("n_nationkey", F.sha2(F.to_json(F.struct("n_name", "n_regionkey")), 256).alias("id")), "select n_nationkey, sha256('{\"n_name\":' || to_json(n_name) || ',\"n_regionkey\":' || n_regionkey || '}') as id from nation")


def exact_values(s, d):
    """Six forms of expressions over each part's size and number, some of them outside their domain."""
    size, number = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    form = F.col("p_partkey") % 6
    by_form = [F.concat_ws(" ", *x) for x in (
        (size, F.lit("7 mul 3 sub"), (F.col("p_partkey") % 5).cast("string"), F.lit("div")), (size, size, F.lit("mul 4 mul 9 div sqrt")), (size, F.lit("sqrt")),
        (size, F.lit("3 choose"), number, F.lit("1 add div")), (F.lit("0"), size, F.lit("sub 7 div floor")), (F.lit("0"), size, F.lit("sub sqrt")),
    )]
    expression = F.coalesce(*[F.when(form == i, e) for i, e in enumerate(by_form)])
    return exact.evaluated(table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), expression.alias("expression")))


query(
    "c15_exact_rationals",
    exact_values,
    """with p as (select p_partkey::bigint as id, p_size::bigint as n from part), f as (select id, n, case id % 6 when 0 then n * 7 - 3 when 1 then 2 * n when 3 then n * (n - 1) * (n - 2) // 6 end as a, case id % 6 when 0 then id % 5 when 1 then 3 when 3 then id + 1 end as b from p),
      g as (select *, case when b > 0 then a // gcd(a, b) end as top, case when b > 0 then b // gcd(a, b) end as below from f)
    select id, case id % 6 when 2 then case when floor(sqrt(n))::bigint ** 2 = n then floor(sqrt(n))::bigint::varchar end when 4 then floor(-n / 7)::bigint::varchar when 5 then null else top || case when below > 1 then '/' || below else '' end end as value,
      case id % 6 when 0 then case when b = 0 then 'zero denominator' end when 2 then case when floor(sqrt(n))::bigint ** 2 <> n then 'irrational root' end when 5 then 'negative radicand' end as error from g""",
)
query("c15_scalar_evaluator", lambda s, d: table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.expr("floor(try_divide(p_size * 7 - 3, p_partkey % 5))").cast("long").alias("value")), "select p_partkey::bigint as id, case when p_partkey % 5 > 0 then floor((p_size * 7 - 3)::double / (p_partkey % 5))::bigint end as value from part")

query(
    "q02_vector_first_retrieval",
    lambda s, d: (lambda seed, r: seed.join(r, "region_id").alias("a").join(r.alias("b"), (F.col("a.source_id") == F.col("b.source_id")) & (F.abs(F.col("a.ordinal") - F.col("b.ordinal")) <= 1)).groupBy("b.region_id").agg(F.max(F.when(F.col("a.region_id") == F.col("b.region_id"), 1.0).otherwise(0.5)).alias("graph_score")))(retrieve.top(retrieve.vector_rank(vectors(s, d), first_vector(s, d)), 10).select("region_id"), ordered_regions(s, d).select("region_id", "source_id", "ordinal")),
    sql(f"with {VEC}, seed as (select region_id from vec order by score desc, region_id limit 10) select b.region_id, max(case when a.region_id = b.region_id then 1.0 else 0.5 end)::double as graph_score from seed join regions a using (region_id) join regions b on a.source_id = b.source_id and abs(a.ordinal - b.ordinal) <= 1 group by 1", "regions", "vectors"),
)
query("q04_trace_claim_dependencies", lambda s, d: graph.reach(recorded(s, d), root(s), 8).join(nodes(s, d), F.col("node") == F.col("node_id")).groupBy("depth", "status").agg(F.count(F.lit(1)).alias("n")), sql(f"with {DISPOSED}, r as (select 2::bigint as node, 0 as depth union select dst, depth + 1 from r join disposed on src = node and disposition = 'recorded' where depth < 8), l as (select node, min(depth) as depth from r group by node) select depth, status, count(*) as n from l join nodes on node = node_id group by all", "nodes", "edges", recursive=True))


def consolidation(s, d):
    """Merged edges after nodes with one role and status collapse into their least node, by relation."""
    n = nodes(s, d)
    mapping = n.join(n.groupBy("role", "status").agg(F.min("node_id").alias("canonical")), ["role", "status"]).select(F.col("node_id").alias("node"), "canonical")
    e = edges(s, d).select((F.col("src") * 100000 + F.col("dst")).alias("id"), F.col("status").alias("relation"), "src", "dst")
    return validate.merged_edges(e, mapping).select("relation", "src", "dst", "merged")


query("q05_consolidation_plan", consolidation, sql("with m as (select node_id, min(node_id) over (partition by role, status) as c from nodes) select e.status as relation, a.c as src, b.c as dst, count(*) as merged from edges e join m a on a.node_id = src join m b on b.node_id = dst group by 1, 2, 3", "nodes", "edges"))
query("q07_prepare_sources", lambda s, d: documents.chunks(regions(s, d).select("region_id", "text")).groupBy("region_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(fn.token_estimate(F.col("text"))).alias("tokens"), F.sum(F.length("text")).alias("chars")))
query("q09_pack_chat_context", lambda s, d: retrieve.first_fit(retrieve.newest_within(history(s, d), 1000, 100).withColumn("item", F.col("turn")), "conv_id", "size", 500, [-F.col("turn")]).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("used").alias("used")))
query("q15_scoped_profiles", lambda s, d: (lambda r: r.withColumn("rn", F.row_number().over(Window.partitionBy("kind", "name").orderBy(F.col("project_id").isNull(), F.desc("seq")))).filter("rn = 1").select("kind", "name", "id"))(records(s, d).filter(store.visible("p3")).withColumn("name", k() % 10)), sql(f"select kind, name, id from (select *, {K_SQL} % 10 as name, row_number() over (partition by kind, {K_SQL} % 10 order by project_id is null, seq desc) as rn from records where project_id is null or project_id = 'p3') where rn = 1", "records"))
query(
    "q16_literature_merge_rank",
    lambda s, d: retrieve.ranked_groups(alias_classes(s, d), "root", "source_id", 50),
    sql(f"""with {ALIASES}, g as (select node, min(root) as root from cc group by node), m as (select root, count(*) as members, count(distinct source_id) as sources
        from g join regions on region_id = node group by root having count(*) > 1)
      select root, members, sources, row_number() over (order by members desc, sources desc, root) as place from m qualify place <= 50""", "regions", recursive=True),
)


def commit_outcomes(s, d):
    """Deltas (purchases), every tenth on an outdated base: committed, stale, or replayed if it was committed before.

    A delta that was stale hasn't been committed, so the same delta on a good base is a commit, no replay.
    """
    r = records(s, d).filter("kind = 'purchase'").select("id", "seq", "corpus_id", F.sha2(F.coalesce("payload", F.lit("")), 256).alias("delta"), (F.col("id") % 10 == 0).alias("outdated"))
    commits = r.filter("not outdated").groupBy("corpus_id", "delta").agg(F.min("seq").alias("at"))
    outcome = F.when(F.col("seq") == F.col("at"), "committed").when(F.col("seq") > F.col("at"), "replayed").otherwise("stale")
    return r.join(commits, ["corpus_id", "delta"], "left").select("id", outcome.alias("outcome"))


COMMITS = """select id, case when count(*) filter (id % 10 <> 0) over (partition by corpus_id, payload order by seq rows between unbounded preceding and 1 preceding) > 0 then 'replayed'
  when id % 10 = 0 then 'stale' else 'committed' end as outcome from records where kind = 'purchase'"""
query("t03_commit_delta", commit_outcomes, sql(COMMITS, "records"))
query("t05_prepare_update", lambda s, d: commit_outcomes(s, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")), sql(f"with c as ({COMMITS}) select outcome, count(*) as n from c group by outcome", "records"))


def report_lines(s, d):
    """A line for each calculation of the order hierarchy, in order of level and name."""
    g = order_dag(s, d)
    level = graph.levels(g, g.select(F.col("src").alias("node")).unionByName(g.select(F.col("dst").alias("node"))))
    inputs = g.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("inputs"))
    return level.join(inputs, "node", "left").select("level", "node", F.concat(F.lit("- "), "node", F.lit(" from "), F.coalesce("inputs", F.lit(0))).alias("line"))


query("s21_calculation_report", report_lines, f"with recursive {DAG}, l as (select distinct src as node, 0 as level from dag union select dst, level + 1 from l join dag on src = node), m as (select node, max(level) as level from l group by node) select level, node, '- ' || node || ' from ' || coalesce(n, 0) as line from m left join (select dst, count(*) as n from dag group by dst) on dst = node")
query("s22_external_metadata", lambda s, d: table(s, d, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", r"^https?://([^/?]+)", 1).alias("host"), F.nullif(F.regexp_extract("html", r'<html lang="([^"]+)"', 1), F.lit("")).alias("lang")), r"""select page_id::bigint as page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(url, '^https?://([^/?]+)', 1) as host, nullif(regexp_extract(html, '<html lang="([^"]+)"', 1), '') as lang from pages""")
query("q18_validate_bundle", lambda s, d: (lambda r: validate.evidence_issues(references(s, d), r, "p1").join(r.select(F.col("region_id").alias("ref_id"), F.sha2("text", 256).alias("artifact_id")), "ref_id").groupBy("artifact_id").agg(F.count_if(F.col("code") == "ok").alias("valid"), F.count(F.lit(1)).alias("refs")))(graded_regions(s, d)), sql(f"with {REFS}, c as ({CODES}) select sha256(s.text) as artifact_id, count(*) filter (code = 'ok') as valid, count(*) as refs from c join regions s on s.region_id = ref_id group by 1", "regions"))
