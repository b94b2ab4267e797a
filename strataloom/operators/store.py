"""Scans, paging, time travel and set operations over append-only records and versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(project: str, visibility: str = "both", column: str = "project_id") -> Column:
    """Rows of the corpus scope (null project), of one project, or both."""
    c = F.col(column)
    return {"corpus": c.isNull(), "project": c == project, "both": c.isNull() | (c == project)}[visibility]


def exact_scope(project: str | None, column: str = "project_id") -> Column:
    """Null-safe equality: null means the corpus scope alone."""
    return F.col(column).eqNullSafe(F.lit(project))


def scan(records: DataFrame, kind: str | None = None, corpus: str | None = None, project: str | None = None) -> DataFrame:
    """Records in insertion order; filters that aren't given don't apply."""
    for name, value in (("kind", kind), ("corpus_id", corpus)):
        if value is not None:
            records = records.filter(F.col(name) == value)
    return (records.filter(visible(project)) if project else records).orderBy("seq")


def with_identity(records: DataFrame) -> DataFrame:
    """Each record's content hash: sha256 of its canonical JSON, keys in order."""
    canonical = F.to_json(F.struct(F.col("corpus_id"), F.col("kind"), F.col("payload"), F.col("project_id")), {"ignoreNullFields": "false"})
    return records.withColumn("identity", F.sha2(canonical, 256))


def get_selected(records: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Records of explicit ids in the order asked; misses drop, repeats repeat."""
    spark = records.sparkSession
    asked = spark.range(1).select(F.posexplode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("place", "wanted"))
    return asked.join(records, F.col("wanted") == F.col("id")).drop("wanted").orderBy("place")


def json_field(path: str, payload: str = "payload") -> Column:
    return F.get_json_object(payload, f"$.{path}")


def first_in_scope(records: DataFrame, key: Column, project: str | None) -> DataFrame:
    """The first record of each logical key in exactly one scope."""
    w = Window.partitionBy("key").orderBy("seq")
    return records.filter(exact_scope(project)).withColumn("key", key).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def keyset_page(records: DataFrame, after: int, limit: int) -> DataFrame:
    """The page after a key, and whether more rows follow."""
    more = records.filter(F.col("id") > after).orderBy("id").limit(limit + 1)
    w = Window.orderBy("id")  # over limit + 1 rows
    return more.withColumn("rn", F.row_number().over(w)).withColumn("has_more", F.max("rn").over(Window.partitionBy(F.lit(1))) > limit).filter(F.col("rn") <= limit).drop("rn")


def offset_page(records: DataFrame, offset: int, limit: int) -> DataFrame:
    return records.orderBy("seq").offset(offset).limit(limit)


def latest(versions: DataFrame, at: int | None = None, keys: Sequence[str] = ("scope", "object_id")) -> DataFrame:
    """Each object's newest version not after a revision. max_by keeps a tombstone's null payload."""
    if at is not None:
        versions = versions.filter(F.col("version") <= at)
    # The payload travels in a struct, so a partial aggregate runs before the shuffle.
    return versions.groupBy(*keys).agg(F.max(F.struct("version", "payload")).alias("v")).select(*keys, "v.version", "v.payload")


def snapshot_at(versions: DataFrame, at: int) -> DataFrame:
    """Live objects at a revision: the newest versions without tombstones."""
    return latest(versions, at).filter(F.col("payload").isNotNull())


def heads(versions: DataFrame) -> DataFrame:
    return versions.groupBy("scope").agg(F.max("version").alias("revision"))


def apply_delta(current: DataFrame, upserts: DataFrame, removals: DataFrame, key: str) -> DataFrame:
    """Current rows without those removed or replaced, and the upserts."""
    gone = removals.select(key).unionByName(upserts.select(key))
    return current.join(gone, key, "left_anti").unionByName(upserts)


def absent_removals(current: DataFrame, removals: DataFrame, key: str) -> DataFrame:
    """Removals of rows that don't exist: an error for a delta."""
    return removals.join(current, key, "left_anti")


def insert_or_ignore(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key isn't there yet, once each."""
    first = Window.partitionBy(key).orderBy("seq")
    return new.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn").join(current, key, "left_anti")


def conflicts(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """Keys with more than one distinct value."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("values")).filter("values > 1")


def partition_violations(declared: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """Members that aren't assigned exactly once, with what is wrong."""
    n = assigned.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = declared.select(key).distinct().withColumn("declared", F.lit(True)).join(n, key, "full")
    problem = F.when(F.col("declared").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select(key, problem.alias("problem")).filter("problem is not null")
