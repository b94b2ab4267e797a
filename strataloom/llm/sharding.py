"""Operator 8: weighted rendezvous hashing of stable record keys over shards.

Each shard draws a uniform number from md5(key:shard); a record goes to the shard with the largest
-weight / ln(u). Adding a shard only adds one more draw, so records move into the new shard alone.

Defined results: a null key hashes as an empty string; a null text has size 1 (no bytes, plus 1) and
checksum 0; slots are gapless from 0 within each shard, in the order of the key's hash. Repeated rows
share a shard and get slots of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, documents, text_of

#: Slots are counted in this many hash buckets a shard, so that no task ranks a whole shard.
BUCKETS = 4096


def draw(key: Column, shard: int) -> Column:
    """52 bits of md5(key:shard) as a number in (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, in which a key belongs."""
    scores = [F.struct((F.lit(-float(w)) / F.log(draw(key, s))).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.greatest(*scores)["shard"] if len(scores) > 1 else F.lit(0)


def shard_records(docs: DataFrame, weights: Sequence[float], added: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each record: id, size, text_crc32, shard, slot and, with one more shard of weight added, grown_shard."""
    key = F.coalesce(column(id_col).cast("string"), F.lit(""))
    bucket = F.conv(F.substring(F.md5(F.concat(key, F.lit(":bucket"))), 1, 8), 16, 10).cast("long") % BUCKETS
    placed = docs.select(column(id_col).alias("doc_id"), key.alias("key"), column(text_col).alias("text")).withColumns({"shard": rendezvous(F.col("key"), weights), "bucket": bucket.cast("int")})
    # At most len(weights) * BUCKETS rows, whatever the input: the only table that is broadcast.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # Rows that agree in everything are one row with a count until their slots are dealt.
    sized = placed.select("doc_id", "key", "shard", "bucket", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32"))
    distinct = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("shard", "bucket").orderBy(F.md5("key"), "key", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = rendezvous(F.col("key"), [*weights, added]) if added is not None else F.lit(None).cast("int")
    return (
        distinct.withColumn("upto", F.sum("copies").over(order))
        .join(F.broadcast(starts), ["shard", "bucket"])
        .withColumn("slot", F.explode(F.sequence(F.col("start") + F.col("upto") - F.col("copies"), F.col("start") + F.col("upto") - 1)))
        .select("doc_id", "size", "text_crc32", "shard", "slot", grown.alias("grown_shard"))
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_records(documents(spark, sf_dir), [1.0] * 8, added=1.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op8_sharding": op8_sharding}
#: CRC-32 of the bytes: a table of 256 remainders, then a fold over each text's bytes.
SQL = {
    "op8_sharding": r"""
    with recursive bits as (select b, b as v, 0 as i from range(256) t(b) union all select b, case when v & 1 = 1 then xor(3988292384, v >> 1) else v >> 1 end, i + 1 from bits where i < 8),
    remainders as (select list(v order by b) as tab from bits where i = 8),
    d as (select row_number() over () as r, doc_id, coalesce(doc_id::varchar, '') as key, coalesce(text, '') as text from documents),
    c as (select r, doc_id, key, octet_length(encode(text)) + 1 as size, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::bigint)) as text_crc32
          from d, remainders),
    s as (select r, i as shard, -1.0::double / ln((('0x' || md5(key || ':' || i)[1:13])::bigint + 0.5::double) / 4503599627370496::double) as score from d, range(9) t(i)),
    b as (select r, arg_max(shard, score) filter (shard < 8) as shard, arg_max(shard, score) as grown_shard from s group by r),
    p as (select c.*, b.shard, b.grown_shard, ('0x' || md5(key || ':bucket')[1:8])::bigint % 4096 as bucket from c join b using (r))
    select doc_id, size::bigint as size, text_crc32, 'key' as law, shard::int as shard,
           row_number() over (partition by shard order by bucket, md5(key), key, size, text_crc32) - 1 as slot, grown_shard::int as grown_shard
    from p
    """
}
