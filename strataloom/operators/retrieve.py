"""Lexical and vector retrieval over text regions, rank fusion, budgets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, occurrences, tokens


def inverted_index(regions: DataFrame) -> DataFrame:
    """token, region_id and how often it stands there."""
    return regions.select("region_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("token", "region_id").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


def projection(index: DataFrame, least: int = 2) -> DataFrame:
    """Tokens of at least so many regions: their number (df), the first region, and the most occurrences in one. The index is made once."""
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("region_id").alias("first"), F.max("tf").alias("most")).filter(F.col("df") >= least)


def lexical_rank(regions: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Regions with a query term: share of distinct terms that they hold. One pass, no join."""
    wanted = sorted(set(terms))
    matched = F.size(F.array_intersect(F.array_distinct(tokens(F.col("text"))), F.array(*map(F.lit, wanted))))
    return regions.select("region_id", matched.cast("long").alias("matched")).filter("matched > 0").withColumn("score", F.col("matched") / F.lit(len(wanted)))


def vector_rank(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """Exact cosine of every vector with the query."""
    return vectors.select("region_id", F.round(cosine(F.col("vector"), F.array(*map(F.lit, query))), 6).alias("score"))


def top(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.orderBy(F.desc("score"), "region_id").limit(k)


def fused(branches: Sequence[DataFrame], depth: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of the branches' best rows: sum of 1 / (constant + rank)."""
    w = Window.orderBy(F.desc("score"), "region_id")  # over at most depth rows
    each = [top(b, depth).select("region_id", F.row_number().over(w).alias("rank")) for b in branches]
    both = each[0]
    for e in each[1:]:
        both = both.unionByName(e)
    return both.groupBy("region_id").agg(F.round(F.sum(1 / (F.lit(constant) + F.col("rank"))), 9).alias("score"))


def idf_rank(regions: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Sum over query terms of log(1 + N / (1 + df)) times the term's count, at most 3."""
    index = regions.select("region_id", F.explode(tokens(F.col("text"))).alias("token")).filter(F.col("token").isin(*terms)).groupBy("token", "region_id").agg(F.count(F.lit(1)).alias("tf"))
    n = regions.agg(F.count(F.lit(1)).alias("n"))
    df = index.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(n)  # a row for each query term
    weight = F.log(1 + F.col("n") / (1 + F.col("df"))) * F.least(F.lit(3), F.col("tf"))
    return index.join(F.broadcast(df), "token").groupBy("region_id").agg(F.round(F.sum(weight), 6).alias("score"))


def substring_score(text: Column, words: Sequence[str]) -> Column:
    total = F.lit(0).cast("long")
    for w in words:
        total = total + occurrences(text, F.lit(w))
    return total


def repeated_lines(regions: DataFrame, least: int = 4) -> DataFrame:
    """Lines of at least so many words that occur more than once."""
    line = F.trim(F.regexp_replace(F.lower("line"), r"\s+", " "))
    lines = regions.select(F.explode(F.split("text", "\n")).alias("line")).select(line.alias("signature")).filter(F.size(F.split("signature", " ")) >= least)
    return lines.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def newest_within(history: DataFrame, budget: int, most: int) -> DataFrame:
    """The newest turns of each conversation up to the first that overflows the budget."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return history.withColumns({"used": F.sum("size").over(running), "place": F.row_number().over(w)}).filter((F.col("used") <= budget) & (F.col("place") <= most))


def first_fit(ranked: DataFrame, key: str, size: str, budget: int, order: Sequence[Column]) -> DataFrame:
    """Items in order that fit the budget; one that doesn't fit is skipped and the next is tried.

    The fold is sequential by definition. Each key's rows stream through it in order, and it holds one sum.
    """
    by = [f"by{i}" for i in range(len(order))]
    rows = ranked.select(key, *[c.alias(b) for b, c in zip(by, order, strict=True)], F.col(size).cast("long").alias("size"), F.col("item").cast("long").alias("item"))
    kind = rows.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = object(), 0
        for batch in batches:
            taken, after = [], []
            for i, (k, n) in enumerate(zip(batch.column("key").to_pylist(), batch.column("size").to_pylist(), strict=True)):
                if k != last:
                    last, used = k, 0
                if n is not None and used + n <= budget:
                    used += n
                    taken.append(i)
                    after.append(used)
            held = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([held.column("key"), pa.array(after, pa.int64()), held.column("item")], names=["key", "used", "item"])

    sorted_rows = rows.repartition(key).sortWithinPartitions(key, *by, "size", "item").select(F.col(key).alias("key"), "size", "item")
    fit = sorted_rows.mapInArrow(fold, f"key {kind}, used long, item long")
    return fit.select(F.col("key").alias(key), F.max("used").over(Window.partitionBy("key")).alias("used"), "item")


def continuation(anchors: DataFrame, regions: DataFrame, k: int) -> DataFrame:
    """The next k regions of each anchor's source, until an ordinal isn't there: anchor, step, region_id.

    anchors: region_id, source_id, ordinal; regions likewise.
    """
    steps = anchors.select(F.col("region_id").alias("anchor"), "source_id", "ordinal", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    found = steps.withColumn("ordinal", F.col("ordinal") + F.col("step")).join(regions.select("region_id", "source_id", "ordinal"), ["source_id", "ordinal"])
    before = F.count(F.lit(1)).over(Window.partitionBy("anchor").orderBy("step"))
    return found.withColumn("before", before).filter("before = step").select("anchor", F.col("step").cast("long").alias("step"), "region_id")


def ranked_groups(rows: DataFrame, group: str, source: str, k: int) -> DataFrame:
    """The k groups of more than one row with the most members, then sources, then the least name, and their places."""
    groups = rows.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.count_distinct(source).alias("sources")).filter("members > 1")
    order = [F.desc("members"), F.desc("sources"), F.col(group)]
    best = groups.orderBy(*order).limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # k rows
