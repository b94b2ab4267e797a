"""Queries of contracts: references, bindings, registries, vocabularies, gates, extraction and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import decide, graph, retrieve, validate
from ..sources.tables import edges, graded_regions, nodes, ordered_regions, records, regions, sql, table
from .checks import CANON, CODES, REFS, canonical, references
from .composites import WEAK, weak
from .graph import DISPOSED, ROOT, recorded, root
from .retrieval import LEX, TERMS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, run, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle


def every(n: int, value, otherwise):
    """A planted value for every n-th region, else the right one."""
    return F.when(F.col("region_id") % n == 0, value).otherwise(otherwise)


# References into regions that are slices of artifacts of sources, with a fault planted for each rule.


def bound_regions(s, d):
    r, begin = graded_regions(s, d), F.col("region_id") % 50
    return r.select(
        "region_id", F.lit("c").alias("corpus_id"), "project_id", "quality",
        every(31, "nowhere", F.col("source_id")).alias("source_id"),
        F.concat(F.lit("a"), "region_id").alias("artifact_id"),
        every(23, F.lit(None), F.concat(F.lit("s"), "source_id")).alias("source_artifact_id"),
        every(29, "r0", F.lit("r1")).alias("source_revision"),
        F.col("region_id").alias("ordinal"), begin.alias("begin"), (begin + 30).alias("end"),
        every(37, "tampered", F.substring("text", (begin + 1).cast("int"), F.lit(30))).alias("text"),
    )


def descriptors(s, d):
    name = F.col("source_id")
    return regions(s, d).select("source_id").distinct().select(
        "source_id", F.when(name.endswith("5"), "p1").alias("project_id"), F.concat(F.lit("s"), name).alias("artifact_id"),
        F.when(name.endswith("3"), "r2").otherwise("r1").alias("source_revision"),
        F.when(name.endswith("7"), "changed").otherwise(F.concat(F.lit("s"), name)).alias("digest"),
    )


def exact_references(s, d):
    r, i, begin = graded_regions(s, d), F.col("region_id"), F.col("region_id") % 50
    return r.select(
        i.alias("ref_id"), every(41, "other", F.lit("c")).alias("corpus_id"), every(43, F.lit(None), F.col("project_id")).alias("project_id"),
        every(19, i + 10**9, i).alias("region_id"), every(53, "a-1", F.concat(F.lit("a"), i)).alias("artifact_id"),
        every(59, "x", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("content_hash"), every(61, "r9", F.lit("r1")).alias("source_revision"),
        every(4, F.lit(None), every(13, "misquoted", F.substring("text", (begin + 1).cast("int"), F.lit(30)))).alias("quotation"),
        every(11, i + 1, i).alias("ordinal"), begin.alias("begin"), (begin + 30).alias("end"),
        every(47, "full", every(2, F.lit(None), F.col("quality"))).alias("quality"),
    )


def artifacts(s, d):
    return regions(s, d).select(F.concat(F.lit("a"), "region_id").alias("artifact_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")


query(
    "v01_validate_evidence",
    lambda s, d: validate.reference_codes(exact_references(s, d), bound_regions(s, d), descriptors(s, d), artifacts(s, d), "c", "p1"),
    sql("""with p as (select *, case when region_id % 43 <> 0 then project_id end as claimed,
        case when region_id % 47 = 0 then 'full' when region_id % 2 <> 0 then quality end as label from regions)
      select region_id as ref_id, case
        when region_id % 41 = 0 or coalesce(claimed <> 'p1', false) then 'scope_mismatch'
        when region_id % 19 = 0 then 'region_missing'
        when coalesce(project_id <> 'p1', false) or claimed is distinct from project_id then 'scope_mismatch'
        when quality = 'fast_provisional' and label is distinct from 'fast_provisional' then 'quality_label_missing'
        when region_id % 31 = 0 or source_id is null then 'source_mismatch'
        when (case when source_id like '%3' then 'r2' else 'r1' end) <> (case when region_id % 29 = 0 then 'r0' else 'r1' end) then 'source_mismatch'
        when region_id % 23 = 0 then 'source_mismatch'
        when source_id like '%7' then 'hash_mismatch'
        when region_id % 53 = 0 then 'artifact_missing'
        when region_id % 59 = 0 then 'hash_mismatch'
        when region_id % 29 = 0 or region_id % 61 = 0 then 'revision_mismatch'
        when text is null or length(text) < region_id % 50 + 30 or region_id % 37 = 0 then 'region_mismatch'
        when region_id % 4 <> 0 and region_id % 13 = 0 then 'quotation_mismatch'
        when region_id % 11 = 0 then 'locator_mismatch'
        when label is not null and label is distinct from quality then 'locator_mismatch'
        else 'ok' end as code from p""", "regions"),
)
query(
    "v08_inventory_binding",
    lambda s, d: validate.binding_issues(bound_regions(s, d), descriptors(s, d)),
    sql("""with c as (select region_id, case
        when region_id % 31 = 0 or source_id is null then 'unknown_source'
        when source_id like '%5' and project_id is distinct from 'p1' then 'project'
        when source_id like '%3' or region_id % 29 = 0 then 'revision'
        when region_id % 23 = 0 then 'artifact' else 'ok' end as issue from regions)
      select * from c where issue <> 'ok'""", "regions"),
)


# Relations that cite two references each; every fifth pair has none.


def relations(s, d):
    kinds, directions = ("analogy", "equivalence_candidate", "implication"), ("neither_established", "both_directions", "forward", "backward")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("relation_id") % len(names) + 1).cast("int"))
    ids = regions(s, d).select(F.expr("region_id div 2").alias("relation_id")).distinct()
    return ids.select("relation_id", pick(kinds).alias("kind"), pick(directions).alias("direction"))


query(
    "v10_relation_citation_binding",
    lambda s, d: validate.relation_issues(relations(s, d), references(s, d).filter("ref_id % 10 < 8").select(F.expr("ref_id div 2").alias("relation_id"), "region", "quotation"), regions(s, d)),
    sql(f"""with {REFS}, f as (select ref_id // 2 as relation_id, count(*) as citations, count(*) filter (not coalesce(contains(text, q), false)) as absent
        from refs left join regions on region_id = region where ref_id % 10 < 8 group by 1), ids as (select distinct region_id // 2 as relation_id from regions)
      select relation_id, coalesce(citations, 0) as citations, case
        when relation_id % 3 = 0 and relation_id % 4 <> 0 then 'analogy_direction'
        when relation_id % 3 = 1 and relation_id % 4 <> 1 then 'equivalence_direction'
        when coalesce(absent, 0) > 0 then 'citation_absent'
        when citations is null then 'not_attributed' else 'ok' end as issue from ids left join f using (relation_id)""", "regions"),
)


# A registry entry and an envelope for each text; the stored bytes once for equal texts.


def registered(s, d):
    i = F.col("region_id")
    own = regions(s, d).select("region_id", "corpus_id", "project_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("artifact_id"))
    named = F.concat(F.lit("e"), "region_id")
    both = own.withColumns({"content_hash": F.col("artifact_id"), "source_revision": F.lit("r1")})
    entries = both.withColumn("envelope_id", F.when(i % 41 != 0, named)).drop("region_id")
    envelopes = both.filter(i % 43 != 0).withColumns({"envelope_id": named, "source_revision": every(47, "r2", F.lit("r1"))}).drop("region_id")
    stored = own.groupBy("artifact_id").agg(F.min("region_id").alias("region_id")).filter(i % 37 != 0)
    return entries, envelopes, stored.select("artifact_id", every(53, "bad", F.col("artifact_id")).alias("digest"))


query(
    "v11_artifact_cross_check",
    lambda s, d: validate.envelope_issues(*registered(s, d)),
    sql("""with a as (select region_id, sha256(coalesce(text, '')) as artifact_id from regions), o as (select artifact_id, min(region_id) as first from a group by 1)
      select case when region_id % 41 <> 0 then 'e' || region_id end as envelope_id, artifact_id, case
        when region_id % 41 = 0 then 'no_envelope_binding' when region_id % 43 = 0 then 'envelope_unavailable' when region_id % 47 = 0 then 'binding_differs'
        when first % 37 = 0 then 'bytes_unavailable' when first % 53 = 0 then 'integrity' else 'ok' end as code from a join o using (artifact_id)""", "regions"),
)


def findings(s, d):
    """An order is a finding that names its parts as entries and one reference."""
    line = table(s, d, "lineitem")
    unknown = F.when((F.col("l_orderkey") % 101 == 0) & (F.col("l_linenumber") == 1), 10**9).otherwise(0)
    return line.select(F.col("l_orderkey").alias("finding_id"), (F.col("l_partkey") + unknown).alias("entry"), F.expr("l_orderkey div 16").alias("ref_id"))


query(
    "v14_vocabulary_findings",
    lambda s, d: validate.finding_issues(findings(s, d), table(s, d, "part").select(F.col("p_partkey").alias("entry")), validate.evidence_issues(references(s, d), graded_regions(s, d), "p1")),
    sql(f"""with {REFS}, c as ({CODES}), f as (select l_orderkey as finding_id, l_orderkey // 16 as ref_id, count(*) as entries,
        bool_or(l_orderkey % 101 = 0 and l_linenumber = 1 or l_partkey not in (select p_partkey from part)) as unknown from lineitem group by 1, 2)
      select finding_id, entries, case when unknown then 'unknown_entry' else 'invalid_evidence' end as issue
        from f left join c using (ref_id) where unknown or code is distinct from 'ok'""", "regions"),
)


# Answers against the part graph.

query(
    "l14_finalization_gates",
    lambda s, d: validate.gates(nodes(s, d), graph.reach(recorded(s, d), root(s))),
    sql(f"""with {DISPOSED}, r as (select {ROOT}::bigint as node union select dst from r join disposed on src = node and disposition = 'recorded'),
        n as (select *, node_id in (select node from r) as reached from nodes)
      select 'target_is_claim' as gate, count(*) filter (node_id = {ROOT} and role = 'obligation') as blocking, blocking = 0 as passed from n
      union all select 'nothing_refuted', count(*) filter (status in ('refuted', 'contradicted')) as b, b = 0 from n
      union all select 'has_obligation', case when count(*) filter (role = 'obligation') = 0 then 1 else 0 end as b, b = 0 from n
      union all select 'obligations_reached', count(*) filter (role = 'obligation' and not reached) as b, b = 0 from n
      union all select 'obligations_resolved', count(*) filter (role = 'obligation' and status not in ('verified', 'supported')) as b, b = 0 from n""", "nodes", "edges", recursive=True),
)


def submissions(s, d):
    """A purchase submits an answer that rests on a node; a node's exact value is 3 times its id modulo 7."""
    support = F.col("id") % 2500
    return records(s, d).filter("kind = 'purchase'").select("id", support.alias("support"), (support * 3 % 7 + F.when(F.col("id") % 9 == 0, 1).otherwise(0)).alias("answer"))


def submitted(s, d):
    n = nodes(s, d)
    due = n.filter("role = 'obligation' and status not in ('verified', 'supported')").select(F.col("node_id").alias("node"))
    below = graph.closure(weak(s, d), due).unionByName(due.select(F.col("node").alias("src"), F.col("node").alias("dst"))).distinct()
    return validate.submission_codes(submissions(s, d), n.withColumn("value", F.col("node_id") * 3 % 7), below)


query(
    "q14_submit_answer",
    submitted,
    sql(f"""with {WEAK}, due as (select node_id from nodes where role = 'obligation' and status not in ('verified', 'supported')),
        below as (select src, dst from cl where dst in (select node_id from due) union select node_id, node_id from due),
        o as (select src, count(*) as unresolved from below group by src),
        a as (select id, id % 2500 as support, (id % 2500) * 3 % 7 + case when id % 9 = 0 then 1 else 0 end as answer from records where kind = 'purchase'),
        c as (select id, support, status, coalesce(unresolved, 0) as unresolved, case when status is null or status in ('failed', 'proposed') then 'unknown_or_failed'
          when answer <> node_id * 3 % 7 then 'differs' else 'bound' end as code from a left join nodes on node_id = support left join o on src = support)
      select id, support, unresolved, code, code = 'bound' and unresolved = 0 and status in ('verified', 'observed') as ready from c""", "nodes", "edges", "records", recursive=True),
)


# Extraction: documents to deltas, coverage of what was found.


def extracted(s, d):
    """An order is an extracted document: its parts are components, its suppliers obligations."""
    component, obligation = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    lost = (F.col("l_orderkey") % 50 == 0) & (F.col("l_linenumber") == 1)
    relation = F.struct(component.alias("subject_id"), F.when(F.col("l_linenumber") % 5 == 0, "mentions").otherwise("requires").alias("predicate"), F.when(lost, "s-missing").otherwise(obligation).alias("object_id"))
    whole = F.struct(F.collect_list(component).alias("components"), F.collect_list(obligation).alias("obligations"), F.collect_list(relation).alias("relations"))
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("object_id")).agg(F.to_json(whole).alias("json"))


query(
    "q19_reference_adapter",
    lambda s, d: validate.extraction_delta(extracted(s, d), s.createDataFrame([("requires", "component", "obligation")], "relation string, src_type string, dst_type string")),
    """select distinct 'upsert_node' as action, 'p' || l_partkey as id, 'component' as type, cast(null as varchar) as target, 'ok' as issue from lineitem
      union all select distinct 'upsert_node', 's' || l_suppkey, 'obligation', null, 'ok' from lineitem
      union all select distinct 'add_edge', 'p' || l_partkey, case when l_linenumber % 5 = 0 then 'mentions' else 'requires' end,
        case when l_orderkey % 50 = 0 and l_linenumber = 1 then 's-missing' else 's' || l_suppkey end,
        case when l_orderkey % 50 = 0 and l_linenumber = 1 then 'missing_target' when l_linenumber % 5 = 0 then 'endpoint_mismatch' else 'ok' end from lineitem""",
)


def concept_delta(s, d):
    """Long words are candidate nodes, neighbours among them candidate edges; both need a region that exists."""
    r = regions(s, d)
    words = r.select(every(19, F.col("region_id") + 10**9, F.col("region_id")).alias("region_id"), fn.plain_words(F.col("text"), 12).alias("w"))
    kept = words.join(r.select("region_id"), "region_id", "left_semi")
    node = F.transform("w", lambda x: F.struct(x.alias("id"), F.lit(None).cast("string").alias("target")))
    pairs = F.arrays_zip(F.col("w").alias("id"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("target"))
    edge = F.filter(pairs, lambda x: x["target"].isNotNull() & (x["id"] != x["target"]))
    found = kept.select("region_id", F.explode(F.array_distinct(F.concat(node, edge))).alias("x")).groupBy("x.id", "x.target").agg(F.count(F.lit(1)).alias("regions"), F.min("region_id").alias("first"))
    return found.withColumn("action", F.when(F.col("target").isNull(), "upsert_node").otherwise("add_edge"))


query(
    "q20_extraction_delta",
    concept_delta,
    sql("""with k as (select region_id, regexp_extract_all(lower(text), '[a-z0-9]{12,}') as w from regions where region_id % 19 <> 0),
        n as (select distinct region_id, unnest(w) as id, cast(null as varchar) as target from k),
        z as (select region_id, unnest(list_zip(w, w[2:])) as p from k), e as (select distinct region_id, p[1] as id, p[2] as target from z where p[2] is not null and p[1] <> p[2])
      select case when target is null then 'upsert_node' else 'add_edge' end as action, id, target, count(*) as regions, min(region_id) as first
        from (select * from n union all select * from e) group by id, target""", "regions"),
)


def sold(s, d):
    """What suppliers of a nation deliver: kinds are the parts' types and sizes."""
    line, part = table(s, d, "lineitem"), table(s, d, "part")
    supplier, nation = table(s, d, "supplier"), table(s, d, "nation")
    kinds = part.select(F.col("p_partkey").alias("l_partkey"), F.lower(F.concat_ws(" ", "p_type", "p_size")).alias("type"))
    where = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("group"), "n_regionkey")
    return line.select("l_partkey", "l_suppkey").join(where, "l_suppkey").join(kinds, "l_partkey").select("group", "n_regionkey", "type").distinct(), kinds


SOLD = "sold as (select distinct n_name as \"group\", n_regionkey, lower(p_type || ' ' || p_size) as type from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join part on p_partkey = l_partkey)"
query(
    "q17_regional_coverage",
    lambda s, d: validate.coverage(*sold(s, d)),
    f"""with {SOLD}, k as (select distinct lower(p_type || ' ' || p_size) as type from part), g as (select "group", count(*) as types from sold group by 1),
        m as (select g."group", k.type from g, k where (g."group", k.type) not in (select "group", type from sold))
      select g."group", types, count(m.type) as missing, coalesce(string_agg(m.type, ',' order by m.type), '') as lacks from g left join m on m."group" = g."group" group by 1, 2""",
)


def compared(s, d):
    """Every pair of nations (25 rows) with what their kinds share and differ in."""
    sets = sold(s, d)[0].groupBy("group", "n_regionkey").agg(F.collect_set("type").alias("kinds"))
    pairs = sets.alias("a").join(F.broadcast(sets.alias("b")), F.col("a.group") < F.col("b.group"))
    n = lambda c: F.size(c).cast("long")
    return pairs.select(
        F.col("a.group").alias("a"), F.col("b.group").alias("b"), n(F.array_intersect("a.kinds", "b.kinds")).alias("shared"),
        n(F.array_except("a.kinds", "b.kinds")).alias("left_only"), n(F.array_except("b.kinds", "a.kinds")).alias("right_only"),
        (F.col("a.n_regionkey") == F.col("b.n_regionkey")).alias("same_region"),
    ).withColumn("same_kinds", (F.col("left_only") == 0) & (F.col("right_only") == 0))


query(
    "q12_pair_inventory",
    compared,
    f"""with {SOLD}, l as (select "group", n_regionkey, list(type) as kinds from sold group by all)
      select a."group" as a, b."group" as b, len(list_intersect(a.kinds, b.kinds))::bigint as shared, len(a.kinds)::bigint - shared as left_only, len(b.kinds)::bigint - shared as right_only,
        a.n_regionkey = b.n_regionkey as same_region, left_only = 0 and right_only = 0 as same_kinds from l a join l b on a."group" < b."group\"""",
)


# Slices, merging, continuation, what an observation is worth.


def slices(s, d):
    """Each text in slices of 700 characters and twice that; every 50th text lacks its third short and second long one."""
    r, cut = regions(s, d), F.col("i") * 700
    short = r.select(F.col("region_id").alias("key"), "end", F.explode(F.expr("sequence(0, greatest(end - 1, 0) div 700)")).alias("i"))
    both = short.select("key", "i", "end", F.explode(F.array(F.lit(700), F.lit(1400))).alias("width"))
    lost = (F.col("key") % 50 == 0) & (F.col("i") == 2)
    return both.filter(~lost).select("key", cut.alias("begin"), F.least(cut + F.col("width"), "end").alias("end"))


query(
    "v12_extraction_batches",
    lambda s, d: validate.covering(slices(s, d), regions(s, d).select(F.col("region_id").alias("key"), F.coalesce("end", F.lit(0)).alias("length"))),
    sql("""with l as (select region_id as key, coalesce("end", 0) as length, key % 50 = 0 and length > 1400 as cut from regions)
      select key, case when cut then 2 else (length + 699) // 700 end as slices, (slices + 31) // 32 as batches,
        case when cut then 1400 else length end as reached, case when cut then 'gap' else 'complete' end as status from l""", "regions"),
)
query(
    "u02_merge_nodes",
    lambda s, d: validate.merged_nodes(nodes(s, d), edges(s, d), canonical(s, d), "status"),
    sql(f"""with {CANON}, m as (select canonical, count(*) as members, string_agg(distinct status, ',' order by status) as status from nodes join canon on node = node_id group by 1),
        p as (select a.canonical, count(distinct b.canonical) as parents from edges join canon a on a.node = src join canon b on b.node = dst where a.canonical <> b.canonical group by 1)
      select canonical, members, status, coalesce(parents, 0) as parents from m left join p using (canonical)""", "nodes", "edges"),
)


def continued(s, d):
    """What follows the 24 best regions in their sources, as far as a project may see it."""
    seen = ordered_regions(s, d).filter("project_id is null or project_id = 'p1'")
    best = retrieve.top(retrieve.lexical_rank(seen, TERMS).select("region_id", "score"), 24)
    return retrieve.continuation(seen.join(best, "region_id", "left_semi"), seen, 5)


query(
    "w06_per_anchor_continuation",
    continued,
    sql(f"""with scoped as (select * from regions where project_id is null or project_id = 'p1'), {LEX.replace('from regions', 'from scoped')},
        best as (select region_id from lex where matched > 0 order by matched desc, region_id limit 24), a as (select * from scoped where region_id in (select region_id from best)),
        f as (select a.region_id as anchor, b.ordinal - a.ordinal as step, b.region_id from a join scoped b on b.source_id = a.source_id and b.ordinal > a.ordinal and b.ordinal <= a.ordinal + 5)
      select anchor, step, region_id from f qualify count(*) over (partition by anchor order by step) = step""", "regions"),
)


def information(s, d):
    """Sources are actions, languages observations; documents are kept, reviewed or dropped by what labels say."""
    j = table(s, d, "documents").select("doc_id", F.col("source").alias("action"), F.col("lang").alias("observation")).join(table(s, d, "labels").select("doc_id", "quality"), "doc_id")
    good, bad = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    worth = F.create_map(F.lit("keep"), 10 * F.col("g") - 5 * F.col("b"), F.lit("review"), 4 * F.col("g") - F.col("b"), F.lit("drop"), F.lit(0).cast("long"))
    spread = lambda df, *keep: df.select(*keep, F.explode(worth).alias("decision", "eu_num"))
    before = j.groupBy("action").agg(F.count(F.lit(1)).alias("den"), good.alias("g"), bad.alias("b"))
    after = j.groupBy("action", "observation").agg(good.alias("g"), bad.alias("b"))
    return spread(before, "action", "den", (F.length("action").cast("long") % 3).alias("cost")), spread(after, "action", "observation")


query(
    "a10_information_value",
    lambda s, d: decide.information_value(*information(s, d)),
    """with l as (select source as action, lang as observation, count(*) as n, count(*) filter (quality = 1) as g, count(*) filter (quality = 0) as b from documents join labels using (doc_id) group by 1, 2),
        o as (select action, sum(greatest(10 * g - 5 * b, 4 * g - b, 0)) as after, sum(n) as den, sum(g) as g, sum(b) as b from l group by 1)
      select action, (after - greatest(10 * g - 5 * b, 4 * g - b, 0) - length(action) % 3 * den)::bigint as value_num, den::bigint as den from o""",
)
