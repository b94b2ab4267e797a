"""The order in which passages are shown: topics first, then by score, each followed by its next passages.

Greedy by definition: a turn takes the passage that holds most topics nobody has covered yet, then the
highest score, then the least rank, and after it up to `adjacent` passages that follow it without a gap in
its source. There are at most as many turns with a gain as topics: each is one aggregate over all rows.
Once nothing gains, the order by score decides, and only one question is left for a row: is it shown in
its own turn, or after a passage that comes earlier? That depends on the few rows before it in its source,
so it is settled for all sources at once, in rounds: who has no undecided row before it that is ranked
better gets a turn, and those behind it follow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .graph import gathered, turns
from .retrieve import continuation


def covering_order(rows: DataFrame, topics: Sequence[str], adjacent: int) -> DataFrame:
    """item, anchor (null: a turn of its own), turn, step; in order of (turn, step).

    rows: item, source_id, ordinal (both unique in the source), score, rank (distinct), topics (array of those it holds).
    """
    held = written(rows.select("item", "source_id", "ordinal", "score", "rank", F.array_intersect("topics", F.array(*map(F.lit, topics)).cast("array<string>")).alias("topics")), "passages")
    spark = held.sparkSession
    chosen: list[tuple] = []
    covered: set[str] = set()
    for turn in range(len(topics)):
        taken = [c[0] for c in chosen]
        left = held.filter(~F.col("item").isin(taken)) if taken else held
        gain = F.size(F.array_except("topics", F.array(*map(F.lit, sorted(covered))).cast("array<string>")))
        best = left.withColumn("gain", gain).filter("gain > 0").agg(F.min(F.struct(-F.col("gain"), -F.col("score"), "rank", "item", "source_id", "ordinal", "topics")).alias("b")).first()["b"]
        if best is None:
            break
        chosen.append((best["item"], None, turn, 0))
        covered.update(best["topics"])
        after = held.filter((F.col("source_id") == best["source_id"]) & F.col("ordinal").between(best["ordinal"] + 1, best["ordinal"] + adjacent)).orderBy("ordinal").collect()  # adjacent rows
        for step, row in enumerate(after, 1):
            if row["ordinal"] != best["ordinal"] + step:
                break
            if row["item"] not in {c[0] for c in chosen}:
                chosen.append((row["item"], best["item"], turn, step))
                covered.update(row["topics"])
    kind = held.schema["item"].dataType.simpleString()
    first = spark.createDataFrame(chosen, f"item {kind}, anchor {kind}, turn long, step int")
    rest = written(held.join(first.select("item"), "item", "left_anti"), "rest")
    # By score, then rank: a dense number that all rows agree on isn't needed, as the pair itself is compared.
    order = F.struct(-F.col("score"), F.col("rank"))
    keyed = rest.select("item", order.alias("key"))
    follow = continuation(held.select(F.col("item").alias("region_id"), "source_id", "ordinal"), held.select(F.col("item").alias("region_id"), "source_id", "ordinal"), adjacent)
    pairs = follow.select(F.col("anchor").alias("a"), F.col("region_id").alias("x"), "step")
    pairs = pairs.join(keyed.select(F.col("item").alias("a"), F.col("key").alias("a_key")), "a").join(keyed.select(F.col("item").alias("x"), F.col("key").alias("x_key")), "x").filter("a_key < x_key")
    pairs = written(pairs.select("a", "x", "step", "a_key"), "pairs")
    open_pairs, undecided, own = pairs, keyed.select("item"), None
    for turn in turns(None):
        new = written(undecided.join(open_pairs.select(F.col("x").alias("item")).distinct(), "item", "left_anti"), "own")
        if new.isEmpty():
            break
        own = new if own is None else gathered(own, new, turn)
        behind = open_pairs.join(new.select(F.col("item").alias("a")), "a", "left_semi").select(F.col("x").alias("item")).distinct()
        undecided = written(undecided.join(new, "item", "left_anti").join(behind, "item", "left_anti"), "undecided")
        open_pairs = written(open_pairs.join(undecided.select(F.col("item").alias("a")), "a", "left_semi").join(undecided.select(F.col("item").alias("x")), "x", "left_semi"), "pairs")
    if own is None:
        return first
    anchors = own.join(keyed, "item")
    led = pairs.join(own.select(F.col("item").alias("a")), "a", "left_semi").join(own.select(F.col("item").alias("x")), "x", "left_anti")
    led = led.groupBy(F.col("x").alias("item")).agg(F.min(F.struct("a_key", "a", "step")).alias("by")).select("item", F.col("by.a").alias("anchor"), F.col("by.a_key").alias("key"), F.col("by.step").cast("int").alias("step"))
    both = written(anchors.select("item", F.lit(None).cast(kind).alias("anchor"), "key", F.lit(0).alias("step")).unionByName(led), "ordered")
    return first.unionByName(numbered_turns(both, len(topics)))


def numbered_turns(rows: DataFrame, start: int) -> DataFrame:
    """item, anchor, turn, step: turns are numbered from start in the order of key.

    Keys are dealt into ranges first; a window numbers the turns of one range only.
    """
    turned = written(rows.filter("step = 0").select("item", "key").repartitionByRange("key").withColumn("range", F.spark_partition_id()), "turns")
    counts = {r["range"]: r["count"] for r in turned.groupBy("range").count().collect()}  # a row for each partition
    offset, starts = start, []
    for r in sorted(counts):
        starts.append((r, offset))
        offset += counts[r]
    place = F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1
    spark = rows.sparkSession
    turn = turned.withColumn("inside", place).join(F.broadcast(spark.createDataFrame(starts, "range int, start long")), "range").select(F.col("item").alias("by"), (F.col("start") + F.col("inside")).cast("long").alias("turn"))
    return rows.withColumn("by", F.coalesce("anchor", "item")).join(turn, "by").select("item", "anchor", "turn", "step")
