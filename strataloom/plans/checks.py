"""Queries of validation, merging, decisions and finite search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import decide, validate
from ..operators.decide import add, const, mul, var
from ..sources.tables import edges, graded_regions, nodes, ordered_regions, regions, sql, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, run, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle


def references(s, d):
    """A reference into every region: some out of bounds, misquoted or to a missing region."""
    r = regions(s, d)
    begin = F.col("region_id") % 50
    end = begin + 30 + F.when(F.col("region_id") % 17 == 0, 10**6).otherwise(0)
    quote = F.when(F.col("region_id") % 13 == 0, "misquoted").otherwise(F.substring(F.col("text"), (begin + 1).cast("int"), F.lit(30)))
    return r.select(F.col("region_id").alias("ref_id"), (F.col("region_id") + F.when(F.col("region_id") % 19 == 0, 10**9).otherwise(0)).alias("region"), begin.alias("begin"), end.alias("end"), quote.alias("quotation"))


REFS = "refs as (select region_id as ref_id, region_id + case when region_id % 19 = 0 then 1000000000 else 0 end as region, region_id % 50 as b, region_id % 50 + 30 + case when region_id % 17 = 0 then 1000000 else 0 end as e, case when region_id % 13 = 0 then 'misquoted' else substring(text, (region_id % 50 + 1)::int, 30) end as q from regions)"
CODES = "select ref_id, case when r.text is null then 'missing' when project_id is not null and project_id <> 'p1' then 'scope' when coalesce(quality, 'full') <> 'full' then 'quality' when b < 0 or e > length(text) or b >= e then 'bounds' when substring(text, (b + 1)::int, (e - b)::int) <> q then 'quotation' else 'ok' end as code from refs left join regions r on region_id = region"
query("j12_evidence_binding", lambda s, d: validate.evidence_issues(references(s, d), graded_regions(s, d), "p2").groupBy("code").agg(F.count(F.lit(1)).alias("n")), sql(f"with {REFS}, c as ({CODES.replace(chr(39) + 'p1' + chr(39), chr(39) + 'p2' + chr(39))}) select code, count(*) as n from c group by code", "regions"))
query("v02_dedup_validation", lambda s, d: (lambda r: r.select("quotation").distinct().select("quotation", fn.normal_statement(F.col("quotation")).alias("normal")).join(r, "quotation").select("ref_id", "normal"))(references(s, d)), sql(rf"with {REFS} select ref_id, trim(regexp_replace(lower(q), '\s+', ' ', 'g')) as normal from refs where q is not null", "regions"))
query("v03_inherited_quality", lambda s, d: graded_regions(s, d).groupBy("source_id").agg(F.bool_or(F.col("quality") == "fast_provisional").alias("provisional"), F.bool_and(F.col("quality").isNotNull()).alias("labelled")).filter("provisional and not labelled").select("source_id"), sql("select source_id from regions group by source_id having bool_or(quality = 'fast_provisional') and not bool_and(quality is not null)", "regions"))
query("v09_citation_grounding", lambda s, d: validate.grounding(regions(s, d).select(F.col("region_id").alias("ref_id"), "text", F.substring("text", 11, 12).alias("quotation")).filter("length(quotation) = 12")), sql("select region_id as ref_id, case when (length(text) - length(replace(text, q, ''))) // 12 = 0 then 'absent' when contains(substring(text, instr(text, q)::int + 1), q) then 'ambiguous' else 'unique' end as grounding from (select *, substring(text, 11, 12) as q from regions) where length(q) = 12", "regions"))
query("v13_read_evidence", lambda s, d: references(s, d).join(regions(s, d).select(F.col("region_id").alias("region"), "text"), "region").filter("end <= length(text)").select("ref_id", F.substring(F.col("text"), (F.col("begin") + 1).cast("int"), F.lit(30)).alias("slice")), sql(f"with {REFS} select ref_id, substring(text, (b + 1)::int, 30) as slice from refs join regions on region_id = region where e <= length(text)", "regions"))


def typed_orders(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    target = F.when(F.col("o_orderkey") % 97 == 0, "c-missing").otherwise(F.concat(F.lit("c"), "o_custkey"))
    links = o.select(F.concat(F.lit("o"), "o_orderkey").alias("src"), target.alias("dst"), F.when(F.col("o_orderstatus") == "P", "ships").otherwise("places").alias("relation"))
    types = o.select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.lit("order").alias("type")).unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.lit("customer").alias("type")))
    return links, types, s.createDataFrame([("places", "order", "customer")], "relation string, src_type string, dst_type string")


query("v04_validate_ontology", lambda s, d: validate.endpoint_issues(*typed_orders(s, d)), "select 'o' || o_orderkey as src, case when o_orderkey % 97 = 0 then 'c-missing' else 'c' || o_custkey end as dst, case when o_orderstatus = 'P' then 'ships' else 'places' end as relation, case when o_orderkey % 97 = 0 then 'missing_target' when o_custkey not in (select c_custkey from customer) then 'missing_target' else 'endpoint_mismatch' end as issue from orders where o_orderkey % 97 = 0 or o_orderstatus = 'P' or o_custkey not in (select c_custkey from customer)")
query("v06_snapshot_integrity", lambda s, d: (lambda e, n: e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("src"), F.lit("duplicate").alias("issue")).unionByName(e.join(n.select(F.col("node_id").alias("dst")), "dst", "left_anti").select("src", F.lit("dangling").alias("issue"))))(edges(s, d).withColumn("dst", F.col("dst") + F.when(F.col("src") % 23 == 0, 10**9).otherwise(0)), nodes(s, d)), sql("with e as (select src, dst + case when src % 23 = 0 then 1000000000 else 0 end as dst from edges) select src, 'duplicate' as issue from e group by src, dst having count(*) > 1 union all select src, 'dangling' from e where dst not in (select node_id from nodes)", "nodes", "edges"))
query("j08_interval_overlap", lambda s, d: (lambda r: validate.overlaps(r.select(F.col("source_id").alias("group"), F.col("region_id").alias("l_id"), (F.col("ordinal") * 700).alias("l_begin"), (F.col("ordinal") * 700 + F.col("end")).alias("l_end")), r.select(F.col("source_id").alias("group"), F.col("region_id").alias("r_id"), (F.col("ordinal") * 700 + 350).alias("r_begin"), (F.col("ordinal") * 700 + 450).alias("r_end")), 1000).select("l_id", "r_id"))(ordered_regions(s, d)), sql('select a.region_id as l_id, b.region_id as r_id from regions a join regions b on a.source_id = b.source_id and a.ordinal * 700 < b.ordinal * 700 + 450 and b.ordinal * 700 + 350 < a.ordinal * 700 + a."end" where a."end" > 0', "regions"))
query("j15_referential_block", lambda s, d: (lambda e: e.filter("event_type <> 'error'").select("event_id", F.explode(F.regexp_extract_all("props", F.lit(r"\d+"), F.lit(0))).alias("m")).join(e.filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("m")).distinct(), "m", "left_semi").select("event_id").distinct())(table(s, d, "events")), r"select distinct event_id from (select event_id, unnest(regexp_extract_all(props, '\d+')) as m from events where event_type <> 'error') where m in (select user_id::varchar from events where event_type = 'error')")


def canonical(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").cast("long").alias("node"), F.lower("p_type").alias("kind"), "p_size")
    return p.join(p.groupBy("kind", "p_size").agg(F.min("node").alias("canonical")), ["kind", "p_size"]).select("node", "canonical")


CANON = "canon as (select p_partkey::bigint as node, min(p_partkey::bigint) over (partition by lower(p_type), p_size) as canonical from part)"
query("u03_edge_dedup_signature", lambda s, d: validate.merged_edges(edges(s, d).select((F.col("src") * 100000 + F.col("dst")).alias("id"), F.col("status").alias("relation"), "src", "dst"), canonical(s, d)), sql(f"with {CANON} select e.status as relation, a.canonical as src, b.canonical as dst, min(src * 100000 + dst) as id, count(*) as merged from edges e join canon a on a.node = src join canon b on b.node = dst group by 1, 2, 3", "edges"))
query("u04_regional_merge", lambda s, d: canonical(s, d).groupBy("canonical").agg(F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_list(F.col("node"))), ",").alias("nodes")), f"with {CANON} select canonical, count(*) as members, string_agg(node::varchar, ',' order by node) as nodes from canon group by canonical")
query("u07_assumption_sets", lambda s, d: (lambda r: r.select("r_name", F.array_join(F.array_sort(F.array_intersect("x", "y")), "").alias("shared"), F.array_join(F.array_sort(F.array_except("x", "y")), "").alias("left_only"), F.array_join(F.array_sort(F.array_except("y", "x")), "").alias("right_only")))(table(s, d, "region").select("r_name", F.array_distinct(F.split("r_name", "")).alias("x"), F.array_distinct(F.split(F.lit("AMERICA"), "")).alias("y"))), "with r as (select r_name, list_distinct(string_split(r_name, '')) as x, list_distinct(string_split('AMERICA', '')) as y from region) select r_name, array_to_string(list_sort(list_intersect(x, y)), '') as shared, array_to_string(list_sort([c for c in x if not list_contains(y, c)]), '') as left_only, array_to_string(list_sort([c for c in y if not list_contains(x, c)]), '') as right_only from r")
query("t04_promotion_remap", lambda s, d: graded_regions(s, d).filter("project_id = 'p1'").select("region_id", F.sha2(F.concat_ws("|", "corpus_id", F.lit("promoted"), F.col("region_id")), 256).alias("promoted_id"), F.col("quality").isNotNull().alias("evidenced")), sql("select region_id, sha256(corpus_id || '|promoted|' || region_id) as promoted_id, quality is not null as evidenced from regions where project_id = 'p1'", "regions"))


def outcomes(s, d):
    """Actions are sources, outcomes the quality of their labelled documents, probabilities counts over a total."""
    j = table(s, d, "documents").select("doc_id", F.col("source").alias("action")).join(table(s, d, "labels").select("doc_id", "quality"), "doc_id")
    n = j.groupBy("action", F.col("quality").cast("long").alias("outcome")).agg(F.count(F.lit(1)).alias("num"))
    total = j.groupBy("action").agg(F.count(F.lit(1)).alias("den"))
    return n.join(total, "action").withColumns({"utility": F.when(F.col("outcome") == 1, 10).otherwise(-5).cast("long"), "cost": F.length("action").cast("long") % 3})


OUT = "o as (select source as action, quality::bigint as outcome, count(*) as num, sum(count(*)) over (partition by source)::bigint as den, case when quality = 1 then 10 else -5 end as utility, length(source) % 3 as cost from documents join labels using (doc_id) group by source, quality)"
EU = "eu as (select action, (sum(num * utility) - max(cost) * max(den))::bigint as eu_num, max(den)::bigint as den from o group by action)"
query("a09_expected_utility", lambda s, d: decide.expected_utility(outcomes(s, d)), f"with {OUT}, {EU} select * from eu")
query("a12_brier", lambda s, d: decide.brier(outcomes(s, d), F.col("outcome") == 1), f"with {OUT} select action, sum((num - case when outcome = 1 then den else 0 end) * (num - case when outcome = 1 then den else 0 end))::bigint as score_num, max(den)::bigint as den from o group by action")
query("k06_eu_winners", lambda s, d: decide.winners(decide.expected_utility(outcomes(s, d))), f"with {OUT}, {EU} select action, eu_num, den from eu qualify rank() over (order by eu_num::decimal(38,12) / den desc) = 1")
query("a11_scenario_bounds", lambda s, d: decide.expected_utility(outcomes(s, d)).select("action", F.least(F.col("eu_num") - F.col("den"), F.col("eu_num"), F.col("eu_num") + 2 * F.col("den")).alias("lower"), F.greatest(F.col("eu_num") - F.col("den"), F.col("eu_num"), F.col("eu_num") + 2 * F.col("den")).alias("upper")), f"with {OUT}, {EU} select action, eu_num - den as lower, eu_num + 2 * den as upper from eu")
query("q10_evaluate", lambda s, d: decide.expected_utility(outcomes(s, d)).select("action", F.round(F.col("eu_num") / F.col("den"), 6).alias("eu")), f"with {OUT}, {EU} select action, round(eu_num::double / den, 6) as eu from eu")

X, Y, Z = var("x"), var("y"), var("z")
SQUARES, FACTORED = add(mul(X, X), mul(Y, Y)), mul(add(X, Y), add(X, Y))
BOX = "b as (select x, y, (x + 3) * 7 + y + 3 as place from (select range::bigint as x from range(-3, 4)), (select range::bigint as y from range(-3, 4)))"
query("c14_polynomial_evaluator", lambda s, d: decide.box(s, ["x", "y"], -3, 3).select("x", "y", decide.compiled(SQUARES).cast("long").alias("l"), decide.compiled(FACTORED).cast("long").alias("r")), f"with {BOX} select x, y, x * x + y * y as l, (x + y) * (x + y) as r from b")
query("c17_integer_witness", lambda s, d: decide.first_witness(decide.violations(decide.box(s, ["x", "y"], -3, 3), SQUARES, "eq", FACTORED), ["x", "y"], 49, 1000), f"with {BOX} select x, y, place + 1 as evaluations, 'witness' as \"end\" from b where x * x + y * y <> (x + y) * (x + y) order by place limit 1")
query("c18_witness_recheck", lambda s, d: decide.violations(decide.box(s, ["x", "y"], -3, 3), SQUARES, "eq", FACTORED).select("x", "y", (2 * F.col("x") * F.col("y") != 0).alias("confirmed")), f"with {BOX} select x, y, 2 * x * y <> 0 as confirmed from b where x * x + y * y <> (x + y) * (x + y)")
query("j14_cross_product_search", lambda s, d: decide.violations(decide.box(s, ["x", "y", "z"], -6, 6), mul(X, Y, Z), "le", const(100)).select("x", "y", "z"), "select x.range::bigint as x, y.range::bigint as y, z.range::bigint as z from range(-6, 7) x, range(-6, 7) y, range(-6, 7) z where x.range * y.range * z.range > 100")
query("q11_search_counterexamples", lambda s, d: decide.first_witness(decide.violations(decide.box(s, ["x", "y", "z"], -6, 6), add(mul(X, X), mul(Y, Y), mul(Z, Z)), "le", const(100)), ["x", "y", "z"], 13**3, 3000), "select x.range::bigint as x, y.range::bigint as y, z.range::bigint as z, (x.range + 6) * 169 + (y.range + 6) * 13 + z.range + 7 as evaluations, 'witness' as \"end\" from range(-6, 7) x, range(-6, 7) y, range(-6, 7) z where x.range * x.range + y.range * y.range + z.range * z.range > 100 order by 4 limit 1")
query("c16_boundary_sampling", lambda s, d: (lambda v: v.select(F.explode(F.array(*[F.lit(n).cast("long") for n in (-10, 10, -9)])).alias("x")).crossJoin(v.select(F.explode(F.array(*[F.lit(n).cast("long") for n in (-10, 10, 0)])).alias("y"))).select("x", "y", F.expr("try_divide(x, y)").isNull().alias("skipped"), F.coalesce(F.expr("x * y > 90"), F.lit(False)).alias("failed")))(s.range(1)), "select x::bigint as x, y::bigint as y, y = 0 as skipped, x * y > 90 as failed from (select unnest([-10, 10, -9]) as x), (select unnest([-10, 10, 0]) as y)")
query("c30_exact_value_parse", lambda s, d: table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.concat("p_size", F.lit("/"), F.col("p_partkey") % 9).alias("v")).select("id", F.when(F.col("v").rlike(r"^-?\d+/[1-9]\d*$"), F.split("v", "/")[0].cast("long")).alias("num"), F.when(F.col("v").rlike(r"^-?\d+/[1-9]\d*$"), F.split("v", "/")[1].cast("long")).alias("den")), "select p_partkey::bigint as id, case when p_partkey % 9 > 0 then p_size::bigint end as num, case when p_partkey % 9 > 0 then (p_partkey % 9)::bigint end as den from part")
query("q13_substantiate_grounding", lambda s, d: validate.evidence_issues(references(s, d), graded_regions(s, d), "p1").join(regions(s, d).select(F.col("region_id").alias("ref_id"), "source_id"), "ref_id").groupBy("source_id", "code").agg(F.count(F.lit(1)).alias("n")), sql(f"with {REFS}, c as ({CODES}) select s.source_id, code, count(*) as n from c join regions s on s.region_id = ref_id group by all", "regions"))
