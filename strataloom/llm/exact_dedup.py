"""Operator 4: exact dedup by 128-bit content hash with a byte comparison inside each hash group.

Defined results: a null text counts as empty; texts are equal when identical after each run of
ASCII white space is one space; of equal texts the smallest id stays, and of repeated rows with that
id exactly one; null ids come last. An empty table gives an empty result. Other columns pass through
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, text_of


def normalised(text: Column) -> Column:
    """Each run of [\\x20\\x09-\\x0D] as one space. Plain replacements first; the regex only where runs are left."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Grouping by (hash, bytes) compares the bytes inside each hash group and is partially aggregated
    before the shuffle, so a group of copies reaches the reducers as one row a task. The way back
    joins on two digests; rows that agree in id and digests are one row with a count until the end,
    so repeated rows need no number and none is in a task with all others.
    """
    norm = docs.select(column(id_col).alias("doc_id"), normalised(text_of(text_col)).alias("norm"))
    id_first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    groups = (
        norm.groupBy(F.unhex(F.md5("norm")).alias("md5"), "norm")
        .agg(F.min(id_first)["id"].alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("md5", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    rows = norm.groupBy("doc_id", F.unhex(F.md5("norm")).alias("md5"), F.unhex(F.sha2("norm", 256)).alias("sha")).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    each = rows.join(groups, ["md5", "sha"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns of docs: one scan and one shuffle.

    The whole row travels in a struct beside its group's key; the least by id, then by place in the
    scan, stays. It is taken before the shuffle in each task and after it once more.
    """
    keyed = docs.select(
        normalised(text_of(text_col)).alias("norm"), F.struct(*[column(c) for c in docs.columns]).alias("doc"), F.struct(column(id_col).isNull(), column(id_col), F.monotonically_increasing_id()).alias("place")
    )
    return keyed.groupBy(F.unhex(F.md5("norm")).alias("md5"), "norm").agg(F.min_by("doc", "place").alias("doc")).select("doc.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = {
    "op4_exact_dedup": r"""
    with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
    select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
           doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
    from t
    """
}
QUERIES = {"op4_exact_dedup": op4_exact_dedup}
