"""Operator 9: mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash of their id. The virtual finish time of a document's k-th
pass is the source's tokens up to its end, all earlier passes included, divided by the source's target.
The queue holds every pass that a document may have; it is range-sorted by finish time over all
sources, and truncated where its running total of tokens would pass the total budget. As the targets
add up to the budget, that is at about finish time 1, so each source ends within a document of its
target; a source without room for more ends when its passes do.

Defined results: a null text has size 0; a null source is a source of its own, the last; a document of
size 0 is taken 0 words, and stays out of the mix if it stands past the cut; repeated rows are taken
one after another. An empty table gives an empty result. A source without words has target 0. Other
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, column, documents, numbered, written

#: Running totals of a source are taken in this many hash buckets, so that no task sums a whole source.
BUCKETS = 4096


def words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, passes: int) -> DataFrame:
    """Target words of each source: one row a source, in and out.

    Targets are min(passes * size, level * weight) with the level at which they share the budget. In
    the order of passes * size / weight the capped sources are a prefix, so the level follows from
    running sums. sizes: columns source, source_size.
    """
    cycle = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    byte_order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    everyone = Window.partitionBy(F.lit(1))
    ranked = sizes.withColumn("place", F.row_number().over(byte_order)).withColumn("weight", cycle.cast("long")).withColumn("cap", F.col("source_size") * passes)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(fill), F.lit(0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(fill), F.lit(0)))
    # The first source whose cap is above the level that is left for it and those after it gives the final level.
    open_ = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "place", "level"))
    final = ranked.withColumn("level", level).withColumn("final", F.min(open_).over(everyone)["level"])
    shared = F.col("final") * F.col("weight")
    return final.select("source", "source_size", F.when(F.col("cap") > shared, shared).otherwise(F.col("cap").cast("double")).alias("target"))


def sizes_of(doc_id: Column, source: Column, text: Column) -> list[Column]:
    return [doc_id.alias("doc_id"), source.cast("string").alias("source"), words(F.coalesce(text.cast("string"), F.lit(""))).alias("size")]


def shuffled(sized: DataFrame, weights: Sequence[int], share: float, passes: int) -> DataFrame:
    """Documents with their place in their source: doc_id, source, size, copies, order, upto, source_size, target.

    Rows that agree in id, source and size are one row with a number of copies; upto is the source's
    running size in order of the id's hash, this row's copies included.
    """
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    bucket = (F.conv(F.substring(F.col("order"), 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")
    distinct = sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("order", order).withColumn("bucket", bucket)
    # Source, bucket and size totals come from one aggregate of at most sources x BUCKETS rows.
    sums = distinct.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("n"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, passes)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    starts = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "t.source_size", "t.target")
    running = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = distinct.withColumn("upto", F.sum(F.col("size") * F.col("copies")).over(running))
    placed = upto.alias("u").join(starts.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")) & (F.col("u.bucket") == F.col("s.bucket")))
    return placed.select("u.doc_id", "u.source", "u.size", "u.copies", "u.order", (F.col("start") + F.col("upto")).alias("upto"), "s.source_size", "s.target")


QUEUE = ["finish", "order", "doc_id", "source", "size", "copy", "pass"]


def fair_queue(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, passes: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The queue in order of finish time, cut at the budget: a row for each document and pass that is taken.

    Columns: doc_id, source, size, source_size, target, copy (1 to copies, for repeated rows), copies,
    pass (0 for each document once, taken or not), finish (null for pass 0).
    """
    return queue_of(docs.select(*sizes_of(column(id_col), column(source_col), column(text_col))), weights, share, passes)


def queue_of(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, passes: int = 2) -> DataFrame:
    """The queue of documents whose sizes are known: doc_id, source, size."""
    placed = written(shuffled(sized, weights, share, passes), "placed")
    budget = placed.select("source", "source_size").distinct().agg(F.sum("source_size").cast("double") * F.lit(float(share))).first()[0] or 0.0
    one = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    end = F.col("upto") - F.col("size") * (F.col("copies") - F.col("copy"))
    entries = one.filter("target > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes)))).withColumn("finish", ((F.col("pass") - 1) * F.col("source_size") + end) / F.col("target"))
    # Each range of the sorted queue is a partition; its number is written with its rows. A total for each range
    # (a row a range) says where the range begins, and a running sum inside the range where each entry ends.
    ranged = written(entries.repartitionByRange(*QUEUE).withColumn("range", F.spark_partition_id()).sortWithinPartitions(*QUEUE), "queue")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranged.groupBy("range").agg(F.sum("size").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("range").orderBy(*QUEUE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = ranged.withColumn("held", F.sum("size").over(inside)).join(begins, "range").filter(F.col("begin") + F.col("held") <= budget)
    columns = ["doc_id", "source", "size", "source_size", "target", "copy", "copies", "pass", "finish"]
    return one.withColumns({"pass": F.lit(0), "finish": F.lit(None).cast("double")}).select(*columns).unionByName(taken.select(*columns))


def numbered_copies(rows: DataFrame) -> DataFrame:
    """Numbered rows (__row, doc_id, source, size) with copy, the place of each among those that agree in all but the number.

    Places are counted for each split of the scan first, so no task ranks more rows than a split has.
    """
    key = ["doc_id", "source", "size"]
    split = rows.withColumn("split", F.shiftright(ROW, 33))
    before = Window.partitionBy(*key).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = split.groupBy(*key, "split").agg(F.count(F.lit(1)).alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = split.withColumn("place", F.row_number().over(Window.partitionBy(*key, "split").orderBy(ROW)))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key]
    joined = ranked.alias("r").join(counts.alias("c"), same[0] & same[1] & same[2] & (F.col("r.split") == F.col("c.split")))
    return joined.select("r.*", (F.col("c.skip") + F.col("r.place")).alias("copy")).drop("split", "place")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, a document of k passes k times, with the columns of docs.

    Of rows that agree in id, source and size, the first of the written table is the queue's first copy.
    """
    rows, doc = numbered(docs), F.col("doc")
    sized = written(rows.select(ROW, *sizes_of(doc[id_col], doc[source_col], doc[text_col])), "sizes")
    takes = queue_of(sized.drop(ROW), **options).filter("pass > 0").groupBy("doc_id", "source", "size", "copy").agg(F.count(F.lit(1)).cast("int").alias("takes"))
    copies = numbered_copies(sized)
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in ("doc_id", "source", "size", "copy")]
    dealt = written(copies.alias("c").join(takes.alias("t"), same[0] & same[1] & same[2] & same[3]).select(F.col(f"c.{ROW}").alias("dealt"), "t.takes"), "dealt")
    joined = rows.join(dealt, rows[ROW] == dealt["dealt"])
    return joined.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("takes")))).select("doc.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = fair_queue(documents(spark, sf_dir))
    return queue.groupBy("doc_id", "source", "size", "copy", "source_size", "target").agg(F.sum(F.when(F.col("pass") > 0, F.col("size")).otherwise(F.lit(0))).alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op9_mixing": r"""
    with d as (
        select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(doc_id::varchar) as shuffle from documents),
    s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
    r as (select *, row_number() over (order by source is null, encode(source)) as place from s),
    w as (select *, cast([5, 2, 1][(place - 1) % 3 + 1] as bigint) as weight, source_size * 2 as cap from r),
    l as (select *, (1.5::double * sum(source_size) over ()::double - coalesce(sum(cap) over o, 0)::double) / (sum(weight) over () - coalesce(sum(weight) over o, 0))::double as level
          from w window o as (order by cap::double / weight::double, place rows between unbounded preceding and 1 preceding)),
    f as (select level from l where cap::double > level * weight::double order by cap::double / weight::double, place limit 1),
    t as (select source, source_size, case when cap::double > (select level from f) * weight::double then (select level from f) * weight::double else cap::double end as target from l),
    q as (select d.doc_id, d.source, d.size, d.shuffle, t.source_size, t.target,
                 sum(d.size) over (partition by d.source order by ('0x' || shuffle[1:8])::bigint % 4096, shuffle, d.doc_id, d.size rows between unbounded preceding and current row) as upto
          from d join t on d.source is not distinct from t.source),
    e as (select *, unnest([0, 1]) as pass from q where target > 0),
    h as (select doc_id, size, (pass * source_size + upto)::double / target as finish, shuffle, source, pass from e),
    g as (select *, sum(size) over (order by finish, shuffle, doc_id, source, size, pass rows between unbounded preceding and current row) as held from h),
    k as (select doc_id, size, source, count(*) as passes from g where held::double <= 1.5::double * (select sum(size) from d)::double group by all)
    select q.doc_id, q.size, q.source_size, q.target, cast(q.size * coalesce(k.passes, 0) as bigint) as taken
    from q left join k on k.doc_id is not distinct from q.doc_id and k.source is not distinct from q.source and k.size = q.size
    """
}
QUERIES = {"op9_mixing": op9_mixing}
