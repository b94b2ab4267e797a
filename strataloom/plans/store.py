"""Queries over records, versions and regions: scans, filters, paging, time travel and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import documents
from ..operators import store as op
from ..sources.shared import written
from ..sources.tables import graded_regions, ordered_regions, records, regions, sql, table, versions

REC = ["id", "seq", "kind", "corpus_id", "project_id", "payload"]
REC_SQL = "id, seq, kind, corpus_id, project_id, payload"
K_SQL = "(payload->>'$.k')::bigint"
SELECTED = [7, 3, 999999999, 12, 3]



def k():
    """The number in a record's payload."""
    return F.get_json_object("payload", "$.k").cast("long")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, run, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle


query("s01_scan_records", lambda s, d: op.scan(records(s, d), "view", "c1", "p2").select(*REC), sql(f"select {REC_SQL} from records where kind = 'view' and corpus_id = 'c1' and (project_id is null or project_id = 'p2')", "records"))
query(
    "s02_scan_integrity",
    lambda s, d: op.with_identity(records(s, d)).select("id", "identity"),
    sql("""select id, sha256('{"corpus_id":' || to_json(corpus_id) || ',"kind":' || to_json(kind) || ',"payload":' || to_json(payload) || ',"project_id":' || coalesce(to_json(project_id)::varchar, 'null') || '}') as identity from records""", "records"),
)
query("s03_scan_source_regions", lambda s, d: ordered_regions(s, d).filter((F.col("source_id") == "src3") & (F.col("ordinal") < 100)).select("region_id", "source_id", "ordinal", "corpus_id", "end"), sql('select region_id, source_id, ordinal, corpus_id, "end" from regions where source_id = \'src3\' and ordinal < 100', "regions"))
query("s04_point_get", lambda s, d: records(s, d).filter((F.col("id") == 42) & (F.col("corpus_id") == "c0") & op.visible("p1")).select(*REC), sql(f"select {REC_SQL} from records where id = 42 and corpus_id = 'c0' and (project_id is null or project_id = 'p1')", "records"))
query("s05_get_selected", lambda s, d: op.get_selected(records(s, d), SELECTED).select(F.col("place").cast("long").alias("place"), "id", "kind"), sql(f"select place::bigint as place, id, kind from (select unnest({SELECTED})::bigint as w, generate_subscripts({SELECTED}, 1) - 1 as place) a join records on id = w", "records"))
query("s06_json_match_scan", lambda s, d: records(s, d).filter(op.json_field("k") == "42").select("id", "kind", "payload"), sql("select id, kind, payload from records where payload->>'$.k' = '42'", "records"))
query(
    "s07_normalized_documents",
    lambda s, d: regions(s, d).filter((F.col("corpus_id") == "en") & F.array_contains(F.split("text", " "), "the")).select("region_id", "source_id"),
    sql("select region_id, source_id from regions where corpus_id = 'en' and list_contains(string_split(text, ' '), 'the')", "regions"),
)
query("s08_receipt_lookup", lambda s, d: op.first_in_scope(records(s, d), k(), None).select("key", "id", "kind"), sql(f"select key, id, kind from (select *, {K_SQL} as key, row_number() over (partition by {K_SQL} order by seq) as rn from records where project_id is null) where rn = 1", "records"))


def prepared(s, d):
    """Ids that preparation receipts (events of type view) name: k and k + 100."""
    return records(s, d).filter("kind = 'view'").select(F.explode(F.array(k(), k() + 100)).alias("region_id")).distinct()


PREPARED = f"prepared as (select distinct unnest([{K_SQL}, {K_SQL} + 100]) as region_id from records where kind = 'view')"


def prepared_window(s, d):
    page = regions(s, d).join(prepared(s, d), "region_id", "left_semi").select("region_id", "source_id").orderBy("region_id").limit(51)
    return page.withColumn("rn", F.row_number().over(Window.orderBy("region_id"))).select("region_id", "source_id", (F.max("rn").over(Window.partitionBy(F.lit(1))) > 50).alias("has_more")).orderBy("region_id").limit(50)


query("s09_prepared_region_window", prepared_window, sql(f"with {PREPARED}, page as (select region_id, source_id from regions where region_id in (select region_id from prepared) order by region_id limit 51) select region_id, source_id, (select count(*) from page) > 50 as has_more from page order by region_id limit 50", "records", "regions"))
query("s10_preparation_membership", prepared, sql(f"with {PREPARED} select region_id from prepared", "records"))
query("s11_keyset_page", lambda s, d: op.keyset_page(records(s, d), 500, 40).select("id", "kind", "has_more"), sql("with p as (select id, kind from records where id > 500 order by id limit 41) select id, kind, (select count(*) from p) > 40 as has_more from p order by id limit 40", "records"))
query("s12_offset_page", lambda s, d: op.offset_page(records(s, d), 30, 25).select("id", "kind"), sql("select id, kind from records order by seq limit 25 offset 30", "records"))
query("s12_scope_counts", lambda s, d: records(s, d).filter(op.exact_scope("p1")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), sql("select kind, count(*) as n from records where project_id = 'p1' group by kind", "records"))
query("s23_artifact_put", lambda s, d: regions(s, d).select(F.sha2("text", 256).alias("artifact_id"), F.octet_length("text").cast("long").alias("size")).distinct(), sql("select distinct sha256(text) as artifact_id, octet_length(encode(text))::bigint as size from regions", "regions"))

query("f01_visible_scope", lambda s, d: records(s, d).select("id", op.visible("p1", "corpus").alias("corpus"), F.coalesce(op.visible("p1", "project"), F.lit(False)).alias("project"), op.visible("p1").alias("both")).withColumn("both", F.coalesce("both", F.lit(False))), sql("select id, project_id is null as corpus, coalesce(project_id = 'p1', false) as project, project_id is null or coalesce(project_id = 'p1', false) as both from records", "records"))
query("f02_preparation_quality", lambda s, d: graded_regions(s, d).select("region_id", F.coalesce("quality", F.lit("full")).alias("quality")), sql("select region_id, coalesce(quality, 'full') as quality from regions", "regions"))
def evidence():
    """Three or fewer evidence entries of a record."""
    return F.transform(F.sequence(F.lit(0), (F.col("id") % 3).cast("int")), lambda i: F.struct(i.alias("place"), ((F.col("id") + i) % 5 == 0).alias("provisional")))
query(
    "f03_provisional_object",
    lambda s, d: records(s, d).select("id", ((F.col("kind") == "error") | F.exists(evidence(), lambda e: e["provisional"])).alias("provisional")),
    sql("select id, kind = 'error' or list_bool_or([(id + i) % 5 = 0 for i in range(0, id % 3 + 1)]) as provisional from records", "records"),
)
query("f05_evidence_locator", lambda s, d: ordered_regions(s, d).select("region_id", F.to_json(F.map_filter(F.create_map(F.lit("ordinal"), F.col("ordinal").cast("string"), F.lit("page"), F.lit("1"), F.lit("end"), F.col("end").cast("string")), lambda k, v: k.isin("ordinal", "end"))).alias("locator")), sql("""select region_id, '{"ordinal":"' || ordinal || '","end":"' || "end" || '"}' as locator from regions""", "regions"))
query("f06_casefold_type_filter", lambda s, d: (lambda p: p.join(F.broadcast(s.createDataFrame([("economy anodized steel",), ("promo brushed tin",), ("standard polished brass",)], "name string")), F.lower("p_type") == F.col("name"), "left").select(F.col("p_partkey").cast("long").alias("id"), F.col("name").isNotNull().alias("known")))(table(s, d, "part")), "select p_partkey::bigint as id, lower(p_type) in ('economy anodized steel', 'promo brushed tin', 'standard polished brass') as known from part")

query("j03_region_adjacency", lambda s, d: (lambda r: r.alias("a").join(r.alias("b"), (F.col("a.source_id") == F.col("b.source_id")) & (F.col("a.ordinal") + 1 == F.col("b.ordinal"))).select(F.col("a.region_id").alias("region_id"), F.col("b.region_id").alias("following")))(ordered_regions(s, d).select("region_id", "source_id", "ordinal")), sql("select a.region_id, b.region_id as following from regions a join regions b on a.source_id = b.source_id and a.ordinal + 1 = b.ordinal", "regions"))
query("j06_membership_semi", lambda s, d: regions(s, d).join(prepared(s, d), "region_id", "left_semi").select("region_id", "source_id"), sql(f"with {PREPARED} select region_id, source_id from regions where region_id in (select region_id from prepared)", "records", "regions"))
query("j07_inventory_left", lambda s, d: s.range(25).select(F.concat(F.lit("src"), "id").alias("source_id")).join(regions(s, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("n")), "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("regions")), sql("select s.source_id, count(r.region_id) as regions from (select 'src' || range as source_id from range(25)) s left join regions r on r.source_id = s.source_id group by s.source_id", "regions"))

CURRENT = "current as (select object_id, payload from (select *, row_number() over (partition by object_id order by version desc) as rn from versions where version <= (select max(version) // 2 from versions)) where rn = 1 and payload is not null)"


def half(s, d):
    return versions(s, d).agg(F.expr("max(version) div 2")).first()[0]


query("t01_read_snapshot_at", lambda s, d: op.snapshot_at(versions(s, d), half(s, d)).select("scope", "object_id", "version", "payload"), sql("select scope, object_id, version, payload from (select *, row_number() over (partition by scope, object_id order by version desc) as rn from versions where version <= (select max(version) // 2 from versions)) where rn = 1 and payload is not null", "versions"))
query("t02_graph_revision", lambda s, d: op.heads(versions(s, d)), sql("select scope, max(version) as revision from versions group by scope", "versions"))
query("w02_latest_version_window", lambda s, d: op.latest(versions(s, d)), sql("select scope, object_id, version, payload from (select *, row_number() over (partition by scope, object_id order by version desc) as rn from versions) where rn = 1", "versions"))
query("j13_correlated_latest", lambda s, d: op.latest(versions(s, d), half(s, d)).select("scope", "object_id", "version"), sql("select scope, object_id, version from versions v where version = (select max(version) from versions w where w.scope = v.scope and w.object_id = v.object_id and w.version <= (select max(version) // 2 from versions))", "versions"))
query("u05_view_union", lambda s, d: (lambda v: v.filter("scope = 0").unionByName(v.filter("scope = 1")))(op.snapshot_at(versions(s, d), half(s, d))).select("scope", "object_id"), sql("select scope, object_id from (select *, row_number() over (partition by scope, object_id order by version desc) as rn from versions where version <= (select max(version) // 2 from versions)) where rn = 1 and payload is not null", "versions"))


def delta(s, d):
    v = op.snapshot_at(versions(s, d), half(s, d)).select("object_id", "payload")
    return v, v.filter("object_id % 7 = 0").withColumn("payload", F.lit('{"k": -1}')), v.filter("object_id % 5 = 1").select("object_id")


query("u01_apply_delta", lambda s, d: op.apply_delta(*delta(s, d), "object_id"), sql(f"""with {CURRENT} select object_id, payload from current where object_id % 7 <> 0 and object_id % 5 <> 1 union all select object_id, '{{"k": -1}}' from current where object_id % 7 = 0""", "versions"))
query("u01_absent_removals", lambda s, d: op.absent_removals(delta(s, d)[0], s.range(0, 200, 9).withColumnRenamed("id", "object_id"), "object_id"), sql(f"with {CURRENT} select range::bigint as object_id from range(0, 200, 9) where range not in (select object_id from current)", "versions"))
query("u06_conflict_check", lambda s, d: op.conflicts(records(s, d).withColumn("key", k()), "key", F.sha2("kind", 256)), sql(f"select {K_SQL} as key, count(distinct sha256(kind)) as values from records group by 1 having count(distinct kind) > 1", "records"))
query("u08_insert_or_ignore", lambda s, d: (lambda r: op.insert_or_ignore(r.filter("kind = 'view'").select("key").distinct(), r.filter("kind = 'error'"), "key").select("key", "id"))(records(s, d).withColumn("key", k() * 100 + F.col("id") % 97)), sql(f"with r as (select *, {K_SQL} * 100 + id % 97 as key from records) select key, min(id) as id from r where kind = 'error' and key not in (select key from r where kind = 'view') group by key", "records"))
query("u09_partition_check", lambda s, d: op.partition_violations(s.range(0, 120), records(s, d).filter("kind = 'signup'").select(k().alias("id")), "id"), sql(f"with a as (select {K_SQL} as id, count(*) as n from records where kind = 'signup' group by 1), m as (select range::bigint as id from range(120)) select coalesce(m.id, a.id) as id, case when m.id is null then 'unknown' when n is null then 'missing' else 'repeated' end as problem from m full join a on m.id = a.id where m.id is null or n is null or n > 1", "records"))

query("a01_count_by_kind", lambda s, d: records(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), sql("select kind, count(*) as n from records group by kind", "records"))
query("a06_max_by_revision", lambda s, d: records(s, d).groupBy("corpus_id", "project_id").agg(F.max_by("id", "seq").alias("id"), F.max("seq").alias("revision")), sql("select corpus_id, project_id, arg_max(id, seq) as id, max(seq) as revision from records group by corpus_id, project_id", "records"))
query("a07_coverage", lambda s, d: s.range(0, 100).withColumnRenamed("id", "required").join(records(s, d).filter("corpus_id = 'c0' and kind = 'error' and project_id = 'p1'").select(k().alias("required")).distinct(), "required", "left_anti"), sql(f"select range::bigint as required from range(100) where range not in (select {K_SQL} from records where corpus_id = 'c0' and kind = 'error' and project_id = 'p1')", "records"))
query("a08_union_evidence", lambda s, d: records(s, d).groupBy("corpus_id", "kind").agg(F.array_join(F.array_sort(F.collect_set(k())), ",").alias("evidence")), sql(f"select corpus_id, kind, list_aggregate(list_sort(list(distinct {K_SQL})), 'string_agg', ',') as evidence from records group by corpus_id, kind", "records"))
query("a14_source_inventory", lambda s, d: graded_regions(s, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == "full").alias("full"), F.count_if(F.col("quality") == "fast_provisional").alias("provisional"), F.sum("end").alias("chars")), sql("select source_id, count(*) as n, count(*) filter (quality = 'full') as full, count(*) filter (quality = 'fast_provisional') as provisional, sum(\"end\")::bigint as chars from regions group by source_id", "regions"))
query("a15_distinct_evidence_ids", lambda s, d: records(s, d).filter("kind = 'purchase'").select(F.explode(F.array(k(), k() * 2, k() + 1)).alias("region_id")).distinct(), sql(f"select distinct unnest([{K_SQL}, {K_SQL} * 2, {K_SQL} + 1]) as region_id from records where kind = 'purchase'", "records"))


def next_ordinals(s, d):
    """The ordinal that follows in a source and project: rows are numbered in ranges, then each meets the next number."""
    r = ordered_regions(s, d).select("region_id", F.to_json(F.struct("source_id", "project_id")).alias("group"), "ordinal")
    n = written(documents.dense(r, "group", "ordinal").select("region_id", "group", "ordinal", "n"), "dense")
    after = n.select("group", (F.col("n") - 1).alias("n"), F.col("ordinal").alias("next_ordinal"))
    return n.join(after, ["group", "n"], "left").select("region_id", "next_ordinal")


query("w03_adjacent_ordinal", next_ordinals, sql("select region_id, lead(ordinal) over (partition by source_id, project_id order by ordinal, region_id) as next_ordinal from regions", "regions"))
query("w07_chain_sequence_check", lambda s, d: (lambda v: v.select("object_id", "version", (F.col("seq") - F.lag("seq").over(Window.partitionBy("object_id").orderBy("version")) != 1).alias("broken")).filter("broken").drop("broken"))(versions(s, d).withColumn("seq", F.expr("version div 100"))), sql("select object_id, version from (select *, version // 100 - lag(version // 100) over (partition by object_id order by version) <> 1 as broken from versions) where broken", "versions"))
query("t06_registry_resolve", lambda s, d: (lambda r: r.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(F.col("project_id").isNull(), "seq"))).filter("rn = 1").select("key", "id", "project_id"))(records(s, d).filter(op.visible("p1")).withColumn("key", k())), sql(f"select key, id, project_id from (select *, {K_SQL} as key, row_number() over (partition by {K_SQL} order by project_id is null, seq) as rn from records where project_id is null or project_id = 'p1') where rn = 1", "records"))
MOVES = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "purchase"), ("purchase", "view"), ("error", "view")]
query("t07_run_state_machine", lambda s, d: (lambda t: t.join(F.broadcast(s.createDataFrame(MOVES, "a string, b string")), (F.col("before") == F.col("a")) & (F.col("kind") == F.col("b")), "left_anti").filter("before is not null and before <> kind").select("id", "before", "kind"))(records(s, d).withColumn("before", F.lag("kind").over(Window.partitionBy("corpus_id", "project_id").orderBy("seq")))), sql("select id, before, kind from (select *, lag(kind) over (partition by corpus_id, project_id order by seq) as before from records) where before is not null and before <> kind and (before || '>' || kind) not in (" + ", ".join(f"'{a}>{b}'" for a, b in MOVES) + ")", "records"))
query("t09_delete_scope_plan", lambda s, d: records(s, d).filter(op.exact_scope("p2")).groupBy("corpus_id", "kind").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("payload")).alias("bytes")), sql("select corpus_id, kind, count(*) as rows, sum(strlen(payload))::bigint as bytes from records where project_id = 'p2' group by corpus_id, kind", "records"))
query("t11_proposals", lambda s, d: (lambda r: r.groupBy("key").agg(F.count(F.lit(1)).alias("offers"), F.count_distinct("kind").alias("payloads"), F.min_by("id", "seq").alias("stored")).withColumn("conflict", F.col("payloads") > 1))(records(s, d).withColumn("key", F.col("id") % 1500 * 100 + k() % 3)), sql(f"select id % 1500 * 100 + {K_SQL} % 3 as key, count(*) as offers, count(distinct kind) as payloads, arg_min(id, seq) as stored, count(distinct kind) > 1 as conflict from records group by 1", "records"))
query("c12_json_path_value", lambda s, d: records(s, d).select("id", op.json_field("k").cast("long").alias("k"), op.json_field("absent").alias("absent")), sql(f"select id, {K_SQL} as k, payload->>'$.absent' as absent from records", "records"))
query("c29_bounded_value", lambda s, d: regions(s, d).select("region_id", F.when(F.octet_length("text") > 1000, F.concat(F.lit("sha256:"), F.sha2("text", 256))).otherwise(F.col("text")).alias("value")), sql("select region_id, case when octet_length(encode(text)) > 1000 then 'sha256:' || sha256(text) else text end as value from regions", "regions"))
query("q06_inspect_corpus", lambda s, d: regions(s, d).groupBy("corpus_id").agg(F.count_distinct("source_id").alias("sources"), F.count(F.lit(1)).alias("regions"), F.sum("end").alias("chars"), F.count_if(F.col("project_id").isNull()).alias("shared")), sql("select corpus_id, count(distinct source_id) as sources, count(*) as regions, sum(\"end\")::bigint as chars, count(*) filter (project_id is null) as shared from regions group by corpus_id", "regions"))
