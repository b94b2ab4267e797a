"""Searches under budgets over regions, graph nodes and their evidence.

Keys are r<region> and n<node>. The driver's tables hold no evidence, so it is planted: a node is
grounded in the region of its number and, for every third size, in the one of half its number. Regions
cite each other by a rule on their numbers. Every fifth node belongs to project p1, others to the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import retrieve
from ..operators.coverage import covering_order
from ..operators.frontier import FREE, Budget, Found, record, scored, search
from ..operators.store import visible
from ..sources.shared import written
from ..sources.tables import edges, ordered_regions, sql, table, vectors
from .retrieval import TOKENS, first_vector

QUERIES: dict = {}
SQL: dict[str, str] = {}
QUESTION = ["the", "der", "steel", "brushed", "small"]
DEPTH = 40


def query(name: str, run, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle


# ---- the searched graph


def region_keys(s, d, visibility: str = "both") -> DataFrame:
    r = ordered_regions(s, d).filter(visible("p1", visibility))
    return r.select(F.concat(F.lit("r"), "region_id").alias("node"), "region_id", "source_id", "project_id", "ordinal", "text")


def node_keys(s, d, visibility: str = "both") -> DataFrame:
    p = table(s, d, "part")
    number, project = F.col("p_partkey").cast("long"), F.when(F.col("p_partkey") % 5 == 0, "p1")
    rows = p.select(F.concat(F.lit("n"), number).alias("node"), number.alias("number"), project.alias("project_id"), "p_size", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return rows.filter(visible("p1", visibility))


def link(rows: DataFrame, source: Column, target: Column, relation: str, direction: int = 0, kind: int = 0) -> DataFrame:
    return rows.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(direction).alias("direction"), F.lit(kind).alias("kind"))


def both_ways(rows: DataFrame, a: Column, b: Column, there: str, back: str, direction: int = 0, kind: int = 0) -> DataFrame:
    return link(rows, a, b, there, 0, kind).unionByName(link(rows, b, a, back, direction, kind))


def evidence_links(regions: DataFrame, nodes: DataFrame) -> DataFrame:
    cited = F.when(F.col("p_size") % 3 == 0, F.array("number", F.expr("number div 2"))).otherwise(F.array("number"))
    bound = nodes.select(F.col("node").alias("n"), F.explode(F.array_distinct(cited)).alias("region_id")).join(regions.select("region_id", F.col("node").alias("r")), "region_id")
    return both_ways(bound, F.col("r"), F.col("n"), "grounds", "source_evidence")


def edge_links(s, d, nodes: DataFrame) -> DataFrame:
    a, b = (nodes.select(F.col("number").alias(end), F.col("node").alias(key)) for end, key in (("src", "a"), ("dst", "b")))
    both = edges(s, d).join(a, "src").join(b, "dst")
    return both_ways(both, F.col("a"), F.col("b"), "requires", "requires", 1)


def adjacent_links(regions: DataFrame, kind: int) -> DataFrame:
    """Regions that follow each other in their source and project."""
    after = regions.select("source_id", F.col("project_id").alias("p"), (F.col("ordinal") - 1).alias("ordinal"), F.col("node").alias("next"))
    pair = regions.join(after, ["source_id", "ordinal"]).filter(F.col("project_id").eqNullSafe(F.col("p")))
    return both_ways(pair, F.col("node"), F.col("next"), "adjacent_region", "adjacent_region", 0, kind)


def citation_links(regions: DataFrame) -> DataFrame:
    """Stored links between regions: every fourth one cites another."""
    n = regions.agg(F.count(F.lit(1)).alias("n"))
    cited = regions.filter("region_id % 4 = 0").crossJoin(n).select(F.col("node").alias("a"), F.expr("(region_id * 5 + 2) % n").alias("region_id"))
    pair = cited.join(regions.select("region_id", F.col("node").alias("b")), "region_id")
    return both_ways(pair, F.col("a"), F.col("b"), "cites", "cites", 1, 1)


def known(regions: DataFrame, nodes: DataFrame | None) -> DataFrame:
    r = regions.select("node", F.lit(True).alias("result"))
    return r if nodes is None else r.unionByName(nodes.select("node", F.lit(False).alias("result")))


REGION_KEYS = "rk as (select 'r' || region_id as node, region_id, source_id, project_id, ordinal, text from regions where {scope})"
NODE_KEYS = "nk as (select * from (select 'n' || p_partkey as node, p_partkey::bigint as number, case when p_partkey % 5 = 0 then 'p1' end as project_id, p_size, p_name || ' ' || p_type as text from part) where {scope})"
SCOPES = {"both": "(project_id is null or project_id = 'p1')", "corpus": "project_id is null", "project": "project_id = 'p1'"}
EVIDENCE = "select distinct n.node as n, r.node as r from (select node, number as region_id from nk union all select node, number // 2 from nk where p_size % 3 = 0) n join rk r using (region_id)"
LINKS = {
    "evidence": f"select r as source, n as target, 'grounds' as relation, 0 as direction, 0 as kind from ({EVIDENCE}) union all select n, r, 'source_evidence', 0, 0 from ({EVIDENCE})",
    "edges": "select a.node as source, b.node as target, 'requires' as relation, 0 as direction, 0 as kind from edges join nk a on a.number = src join nk b on b.number = dst union all select b.node, a.node, 'requires', 1, 0 from edges join nk a on a.number = src join nk b on b.number = dst",
    "adjacent": "select a.node as source, b.node as target, 'adjacent_region' as relation, 0 as direction, {kind} as kind from rk a join rk b on a.source_id = b.source_id and a.project_id is not distinct from b.project_id and abs(a.ordinal - b.ordinal) = 1",
    "cites": "select a.node as source, b.node as target, 'cites' as relation, 0 as direction, 1 as kind from rk a join rk b on b.region_id = (a.region_id * 5 + 2) % (select count(*) from rk) where a.region_id % 4 = 0 union all select b.node, a.node, 'cites', 1, 1 from rk a join rk b on b.region_id = (a.region_id * 5 + 2) % (select count(*) from rk) where a.region_id % 4 = 0",
}


def search_sql(b: Budget, seeds: str) -> str:
    """The search as one set of common table expressions a hop; the relations links and known are there. Ends with visited and figures."""
    big = 1 << 62
    cap, most, nodes, results = (big if x is None else x for x in (b.neighbours, b.edges, b.nodes, b.results))
    out = [f"v0 as (select s.node, k.result, 0 as depth, s.place::bigint as place, null::varchar as parent, null::varchar as relation, [s.node] as path from ({seeds}) s join known k on k.node = s.node), f0 as (select * from v0)"]
    out.append("st0 as (select 0::bigint as examined, (select count(*) from v0) as visited, (select count(*) from v0 where result) as results, false as limited, false as over)")
    spent = f"(examined >= {most} or visited >= {nodes} or results >= {results})"
    for h in range(1, b.hops + 1):
        p = h - 1
        stopped = f"(select {spent} from st{p})" if b.stop else "false"
        fit = f"found <= {nodes} - (select visited from st{p})"
        if b.stop:
            kept = f"select * from new{h} where {fit} and held - result::int < {results} - (select results from st{p})"
        else:
            kept = f"select * exclude (found), row_number() over (order by number) as found from new{h} where not result or held <= {results} - (select results from st{p})"
            kept = f"select * from ({kept}) where {fit}"
        out.append(f"m{h} as (select f.place, f.node, f.path, l.target, l.relation, l.kind, row_number() over (partition by f.place, l.kind = {FREE} order by l.kind, l.target, l.relation, l.direction) as rank from f{p} f join links l on l.source = f.node where not {stopped})")
        out.append(f"e{h} as materialized (select *, row_number() over (order by place, kind = {FREE}, rank) as number from m{h} where kind = {FREE} or rank <= {cap})")
        out.append(f"u{h} as (select * from e{h} where number <= {most} - (select examined from st{p}) and target not in (select node from v{p}) qualify row_number() over (partition by target order by number) = 1)")
        out.append(f"new{h} as materialized (select u.*, k.result, sum(k.result::int) over (order by number) as held, row_number() over (order by number) as found from u{h} u join known k on k.node = u.target)")
        out.append(f"f{h} as materialized (select target as node, result, {h} as depth, (select visited from st{p}) + found - 1 as place, node as parent, relation, list_append(path, target) as path, number from ({kept}))")
        out.append(f"v{h} as (select * from v{p} union all select * exclude (number) from f{h})")
        out.append(f"t{h} as (select (select visited from st{p}) + (select count(*) from f{h}) as visited, (select results from st{p}) + (select count(*) from f{h} where result) as results, (select count(*) from e{h}) as total, (select count(*) from m{h} where kind <> {FREE} and rank > {cap}) > 0 as capped)")
        full = f"(visited >= {nodes} or results >= {results})" if b.stop else "false"
        looked = f"case when {stopped} then 0 when {full} then (select max(number) from f{h}) else least(total, {most} - (select examined from st{p})) end"
        out.append(f"w{h} as (select *, coalesce({looked}, 0) as looked from t{h})")
        later = f"(select count(*) from f{p} where place > coalesce((select max(place) from e{h} where number = looked), -1)) > 0"
        unspent = f"(({full} or (select examined from st{p}) + looked >= {most}) and {later})" if b.stop else f"(select count(*) from new{h}) > (select count(*) from f{h})"
        begun = f"({stopped} and (select count(*) from f{p}) > 0)"
        out.append(f"st{h} as (select (select examined from st{p}) + looked as examined, visited, results, (select limited from st{p}) or capped or looked < total or {unspent} or {begun} as limited, {stopped} as over from w{h})")
    last = b.hops
    ahead = f"(select count(*) from f{last}) > 0" if b.stop else f"(select count(*) from f{last} f join links l on l.source = f.node where l.target not in (select node from v{last})) > 0"
    out.append(f"visited as (select * from v{last})")
    out.append(f"figures as (select visited as visited_nodes, examined as examined_edges, limited, {ahead} as hop_limited, results as selected from st{last})")
    return ", ".join(out)


# ---- research retrieval: ranked regions and graph nodes, then a search around the best


def matched(rows: DataFrame) -> DataFrame:
    """Share of the question's words in each row's text; rows without any don't count."""
    hits = F.size(F.array_intersect(F.array_distinct(fn.tokens(F.col("text"))), F.array(*map(F.lit, QUESTION))))
    return rows.select(F.col("node").alias("region_id"), (hits / F.lit(len(QUESTION))).alias("score")).filter("score > 0")


def ordered(ranked: DataFrame) -> DataFrame:
    """A few ranked rows as seeds, numbered from 0."""
    best = ranked.orderBy(F.desc("score"), "region_id")
    return ranked.sparkSession.createDataFrame([(r["region_id"], i) for i, r in enumerate(best.collect())], "node string, place long")


def researched(s, d, knowledge: str, visibility: str, budget: Budget, limit: int) -> Found:
    """knowledge: sources (regions alone), graph (nodes, without their evidence) or both."""
    regions = region_keys(s, d, visibility)
    nodes = None if knowledge == "sources" else node_keys(s, d, visibility)
    links = adjacent_links(regions, 0)
    branches = [matched(regions)]
    if nodes is not None:
        links = links.unionByName(edge_links(s, d, nodes))
        branches.append(matched(nodes))
        if knowledge == "both":
            links = links.unionByName(evidence_links(regions, nodes))
    best = retrieve.top(retrieve.fused(branches, DEPTH) if nodes is not None else branches[0], limit)
    return search(links, known(regions, nodes), ordered(best), budget)


def steps(found: Found) -> DataFrame:
    return found.visited.select("node", "depth", F.col("place").cast("long").alias("place"), "parent", "relation")


def researched_sql(knowledge: str, visibility: str, budget: Budget, limit: int, end: str) -> str:
    scope = SCOPES[visibility]
    words = ", ".join(f"'{w}'" for w in QUESTION)

    def branch(rows: str) -> str:
        score = f"select node, len(list_intersect(list_distinct({TOKENS}), [{words}])) / {len(QUESTION)} as score from {rows}"
        return f"select node, row_number() over (order by score desc, node) as rank from ({score}) where score > 0 qualify rank <= {DEPTH}"

    kinds = [LINKS["adjacent"].format(kind=0)] + ([] if knowledge == "sources" else [LINKS["edges"]]) + ([LINKS["evidence"]] if knowledge == "both" else [])
    nodes = "" if knowledge == "sources" else " union all select node, false from nk"
    ranks = branch("rk") if knowledge == "sources" else f"{branch('rk')}) union all select * from ({branch('nk')}"
    parts = [REGION_KEYS.format(scope=scope), NODE_KEYS.format(scope=scope), f"links as materialized ({' union all '.join(kinds)})", f"known as (select node, true as result from rk{nodes})"]
    parts.append(f"ranked as (select node, round(sum(1.0::double / (60 + rank)), 9) as score from (select * from ({ranks})) group by node), best as materialized (select node, row_number() over (order by score desc, node) - 1 as place from ranked qualify place < {limit})")
    return sql(f"with {', '.join(parts)}, {search_sql(budget, 'select node, place from best')} {end}", "regions", "edges", recursive=True)


STEPS = "select node, depth, place, parent, relation from visited"
TIGHT = Budget(hops=4, neighbours=3, edges=300, nodes=150, results=60)

for _name, _knowledge, _visibility, _budget in (
    ("g01_frontier_budgets", "both", "both", TIGHT),
    ("q01_graph_branch", "graph", "both", Budget(hops=3, neighbours=8, edges=400, nodes=200)),
    ("q01_sources_branch", "sources", "both", Budget(hops=6, neighbours=8, results=40)),
    ("q01_corpus_scope", "both", "corpus", Budget(hops=2)),
    ("q01_project_scope", "both", "project", Budget(hops=3, neighbours=2)),
):
    query(_name, lambda s, d, a=(_knowledge, _visibility, _budget, 12): steps(researched(s, d, *a)), researched_sql(_knowledge, _visibility, _budget, 12, STEPS))
query("w08_frontier_cap", lambda s, d: steps(researched(s, d, "both", "both", Budget(1, neighbours=2), 24)), researched_sql("both", "both", Budget(1, neighbours=2), 24, STEPS))


def budget_flags(s, d):
    found = researched(s, d, "both", "both", TIGHT, 12)
    return record(found, region_keys(s, d).select("node"), TIGHT, 10)


RECORD = """, omitted as (select node from {indexed} where node not in (select node from visited where result))
  select f.*, (select count(*) from omitted) as omitted_count, (select array_to_string(list(node order by node), ',') from (select node from omitted order by node limit {sample})) as omitted from figures f"""
query("g01_budget_flags", budget_flags, researched_sql("both", "both", TIGHT, 12, RECORD.format(indexed="rk", sample=10)))


# ---- vector-first search: typed links, stored links and neighbouring regions at once, whole paths


PATHS = Budget(hops=3, neighbours=4, edges=260, nodes=140, results=70, stop=True)


def vector_first(s, d, budget: Budget) -> tuple[Found, DataFrame]:
    regions, nodes = region_keys(s, d), node_keys(s, d)
    indexed = vectors(s, d).join(regions.select("region_id", "node"), "region_id")
    best = retrieve.top(retrieve.vector_rank(indexed, first_vector(s, d)), 10).select(F.concat(F.lit("r"), "region_id").alias("region_id"), "score")
    links = evidence_links(regions, nodes).unionByName(edge_links(s, d, nodes)).unionByName(citation_links(regions)).unionByName(adjacent_links(regions, FREE))
    return search(links, known(regions, nodes), ordered(best), budget), indexed.select("node")


def vector_first_sql(budget: Budget, end: str) -> str:
    parts = [REGION_KEYS.format(scope=SCOPES["both"]), NODE_KEYS.format(scope=SCOPES["both"])]
    parts.append(f"links as materialized ({' union all '.join([LINKS['evidence'], LINKS['edges'], LINKS['cites'], LINKS['adjacent'].format(kind=FREE)])}), known as (select node, true as result from rk union all select node, false from nk)")
    parts.append("ix as (select r.node, round(list_cosine_similarity(vector, (select vector from vectors order by region_id limit 1)), 6) as score from vectors v join rk r using (region_id)), best as materialized (select node, row_number() over (order by score desc, node) - 1 as place from (select * from ix order by score desc, substr(node, 2)::bigint limit 10))")
    return sql(f"with {', '.join(parts)}, {search_sql(budget, 'select node, place from best')} {end}", "regions", "edges", "vectors", recursive=True)


SCORED = "select node, depth, place, case when depth > 0 then 1.0::double / len(path) end as score, array_to_string(path, '>') as path from visited where result"
for _name, _budget in (("g02_path_search", Budget(hops=2)), ("g02_path_budgets", PATHS)):
    query(_name, lambda s, d, b=_budget: scored(vector_first(s, d, b)[0]).withColumn("path", F.array_join("path", ">")), vector_first_sql(_budget, SCORED))


def selection(s, d):
    found, indexed = vector_first(s, d, PATHS)
    return record(found, indexed, PATHS, 20)


query("q02_selection_record", selection, vector_first_sql(PATHS, RECORD.format(indexed="ix", sample=20)))


# ---- the order of passages for an answer


TOPICS = ["der", "eaux", "ción", "steel"]


def passages(s, d, words: list[str], most: int) -> DataFrame:
    """The best regions for the words, with a score of their own lines: lines of four words or more that several of them share don't count."""
    r = ordered_regions(s, d)
    ranked = retrieve.lexical_rank(r, words).orderBy(F.desc("matched"), "region_id").limit(most).collect()
    places = s.createDataFrame([(x["region_id"], i) for i, x in enumerate(ranked)], "region_id long, rank long")
    kept = written(r.join(places, "region_id").select(F.col("region_id").alias("item"), F.concat_ws("|", "source_id", F.coalesce("project_id", F.lit(""))).alias("source_id"), "ordinal", "rank", "text"), "packet")
    letters = F.transform(F.regexp_extract_all(F.lower("line"), F.lit(r"\p{L}+"), F.lit(0)), fn.singular)
    lines = kept.select("item", F.explode(F.split("text", r"\R")).alias("line")).select("item", letters.alias("words")).withColumn("signature", F.array_join("words", " "))
    shared = lines.filter(F.size("words") >= 4).groupBy("signature").count().filter("count > 1").select("signature")
    body = lines.join(shared, "signature", "left_anti").select("item", F.explode("words").alias("word")).filter(F.col("word").isin(*words)).groupBy("item", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = body.groupBy("word").agg(F.count(F.lit(1)).alias("df"))  # a row for each word asked
    weight = F.log(1 + F.lit(len(ranked)) / (1 + F.col("df"))) * F.least(F.lit(3), F.col("tf"))
    scores = body.join(F.broadcast(df), "word").groupBy("item").agg(F.round(F.sum(weight), 9).alias("score"), F.collect_set("word").alias("topics"))
    return kept.join(scores, "item", "left").select("item", "source_id", "ordinal", F.coalesce("score", F.lit(0.0)).alias("score"), "rank", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))


def shown(s, d):
    """Passages in the order in which they are shown, within a budget of half their bytes as tokens."""
    order = covering_order(passages(s, d, TOPICS, 120), TOPICS, 2)
    sized = order.join(ordered_regions(s, d).select(F.col("region_id").alias("item"), fn.token_estimate(F.col("text")).alias("size")), "item")
    fit = retrieve.first_fit(sized.withColumn("packet", F.lit(0)), "packet", "size", 20_000, [F.col("turn"), F.col("step")]).select("item", F.lit(True).alias("fit"))
    return sized.join(fit, "item", "left").select("item", "anchor", "turn", F.col("step").cast("long").alias("step"), "size", F.coalesce("fit", F.lit(False)).alias("fits"))


query("k09_topic_order", shown)
