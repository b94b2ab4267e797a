"""The store's relations as views of the driver's tables.

Each adapter takes (spark, sf_dir); SQL holds the same relation as a DuckDB common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Ids of a range in which regions are numbered.
BUCKET = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only records: id, seq, kind, corpus_id, project_id (null: corpus scope), payload (JSON)."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("long")
    return e.select(
        F.col("event_id").cast("long").alias("id"),
        F.col("event_id").cast("long").alias("seq"),
        F.col("event_type").alias("kind"),
        F.concat(F.lit("c"), user % 3).alias("corpus_id"),
        F.when(user % 4 != 0, F.concat(F.lit("p"), user % 4)).alias("project_id"),
        F.col("props").alias("payload"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned objects: scope, object_id, version, payload (null: tombstone)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id").cast("long") % 2).alias("scope"),
        F.col("user_id").cast("long").alias("object_id"),
        F.col("event_id").cast("long").alias("version"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("payload"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text regions of sources: region_id, source_id, text, corpus_id, project_id, begin, end. No shuffle."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("region_id"),
        F.col("source").alias("source_id"),
        "text",
        F.col("lang").alias("corpus_id"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("p"), F.col("doc_id") % 3)).alias("project_id"),
        F.lit(0).cast("long").alias("begin"),
        F.length("text").cast("long").alias("end"),
    )


def ordered_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their ordinal in the source.

    They are counted in ranges of BUCKET ids first; a window numbers the rows of one range only, so a
    source's texts are never sorted by one task.
    """
    r = regions(spark, sf_dir).withColumn("bucket", F.expr(f"region_id div {BUCKET}"))
    before = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = r.groupBy("source_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(F.col("source_id").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("source_id", "bucket").orderBy("region_id")) - 1
    placed = r.withColumn("inside", inside).join(starts, F.col("source_id").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return placed.withColumn("ordinal", F.col("start") + F.col("inside")).drop("bucket", "inside", "s", "b", "start")


def graded_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with the quality that their label gives them: one label a region, the least if there are several."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("q"))
    quality = F.when(F.col("q") == 0, "fast_provisional").when(F.col("q") == 1, "full")
    return regions(spark, sf_dir).join(labels, F.col("region_id") == F.col("l_id"), "left").withColumn("quality", quality).drop("l_id", "q")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, vector (doubles) and label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("region_id"), F.col("embedding").cast("array<double>").alias("vector"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes: node_id, role, status."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey").cast("long").alias("node_id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("proposed", "refuted", "failed", "contradicted", "unresolved", "verified", "observed", "supported", "supported", "supported", "supported")]), (F.col("p_partkey") % 11 + 1).cast("int"))
    return p.select(n, F.when(F.col("p_partkey") % 4 == 1, "obligation").otherwise("statement").alias("role"), status.alias("status"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed graph edges: src, dst, status."""
    p = table(spark, sf_dir, "part")
    n = p.agg(F.count(F.lit(1)).alias("n"))
    key = F.col("p_partkey").cast("long")
    jump = p.filter(F.col("p_partkey") % 13 != 0).crossJoin(n).select(key.alias("src"), ((key * 7 + 3) % F.col("n")).alias("dst"))
    far = p.filter(F.col("p_size") % 5 == 0).crossJoin(n).select(key.alias("src"), ((key + F.expr("n div 3")) % F.col("n")).alias("dst"))
    status = F.when((F.col("src") * 31 + F.col("dst")) % 10 == 0, "proposed").when((F.col("src") * 31 + F.col("dst")) % 10 == 1, "refuted").otherwise("supported")
    return jump.unionByName(far).distinct().withColumn("status", status)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with their estimated size: conv_id, turn, role, text, size."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.ceil(F.octet_length("text") / 2).cast("long").alias("size"))


SQL = {
    "records": "records as (select event_id::bigint as id, event_id::bigint as seq, event_type as kind, 'c' || (user_id % 3) as corpus_id, case when user_id % 4 <> 0 then 'p' || (user_id % 4) end as project_id, props as payload from events)",
    "versions": "versions as (select (user_id % 2)::bigint as scope, user_id::bigint as object_id, event_id::bigint as version, case when event_type <> 'error' then props end as payload from events)",
    "regions": "regions as (select d.doc_id::bigint as region_id, source as source_id, (row_number() over (partition by source order by d.doc_id) - 1)::bigint as ordinal, text, lang as corpus_id, case when d.doc_id % 3 <> 0 then 'p' || (d.doc_id % 3) end as project_id, 0::bigint as begin, length(text)::bigint as \"end\", case l.quality when 0 then 'fast_provisional' when 1 then 'full' end as quality from documents d left join labels l on l.doc_id = d.doc_id)",
    "vectors": "vectors as (select vec_id::bigint as region_id, embedding::double[] as vector from embeddings)",
    "nodes": "nodes as (select p_partkey::bigint as node_id, case when p_partkey % 4 = 1 then 'obligation' else 'statement' end as role, ['proposed', 'refuted', 'failed', 'contradicted', 'unresolved', 'verified', 'observed', 'supported', 'supported', 'supported', 'supported'][p_partkey % 11 + 1] as status from part)",
    "edges": "edges as (select src, dst, case when (src * 31 + dst) % 10 = 0 then 'proposed' when (src * 31 + dst) % 10 = 1 then 'refuted' else 'supported' end as status from (select p_partkey::bigint as src, (p_partkey::bigint * 7 + 3) % (select count(*) from part) as dst from part where p_partkey % 13 <> 0 union select p_partkey::bigint, (p_partkey::bigint + (select count(*) from part) // 3) % (select count(*) from part) from part where p_size % 5 = 0))",
    "history": "history as (select conv_id::bigint as conv_id, turn::bigint as turn, role, text, ceil(octet_length(encode(text)) / 2)::bigint as size from conversations)",
}


def sql(query: str, *names: str, recursive: bool = False) -> str:
    """A DuckDB query over adapters; the query may begin with more common table expressions."""
    first, rest = ", ".join(SQL[n] for n in names), query.strip()
    more = rest.lower().startswith("with ")
    return f"with {'recursive ' if recursive else ''}{first}{', ' + rest[5:] if more else ' ' + rest}"
