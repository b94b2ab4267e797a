"""Search from ordered seeds along links, hop by hop, under budgets for neighbours, edges, nodes and results.

The order is part of the result: seeds come in theirs, a hop looks at the frontier's nodes in the order in
which they were found, and at each node's links in order of (kind, target, relation, direction). Budgets
cut that sequence at exact places. A hop is a handful of joins and two running counts; counts run over
ranges of PLACES places and then over the ranges' sums, so no task sorts a whole frontier.

Two rules for what happens at a budget:
- skip: an edge past the node or result budget is passed over and the next one is looked at, so other
  nodes can still be found when results have run out;
- stop: nothing is looked at any more once a budget is used up.

Links: source, target, relation (string), direction (int), kind (int: links of kind FREE are looked at
after the others and don't count for the cap on neighbours). Nodes: node, result (boolean: whether it
counts for the result budget); links to others are looked at and lead nowhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .graph import counted, gathered

FREE = 9
PLACES = 256
NO_LIMIT = 1 << 62


@dataclass(frozen=True)
class Budget:
    """None: without a limit."""

    hops: int
    neighbours: int | None = None
    edges: int | None = None
    nodes: int | None = None
    results: int | None = None
    stop: bool = False


@dataclass(frozen=True)
class Found:
    """visited: node, result, depth, place (order of discovery), parent, relation, direction, path; and the search's figures."""

    visited: DataFrame
    examined: int
    nodes: int
    results: int
    limited: bool
    hop_limited: bool


def running(rows: DataFrame, place: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums in the order of (place, order); place is a number that few rows share."""
    ranged = rows.withColumn("range", F.expr(f"{place} div {PLACES}"))
    inside = Window.partitionBy("range").orderBy(place, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = ranged.groupBy("range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    starts = totals.select(F.col("range").alias("of"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"start_{n}") for n in sums])
    placed = ranged.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(starts, F.col("range") == F.col("of"))
    return placed.withColumns({n: F.col(n) + F.col(f"start_{n}") for n in sums}).drop("range", "of", *[f"start_{n}" for n in sums])


def search(links: DataFrame, nodes: DataFrame, seeds: DataFrame, budget: Budget) -> Found:
    """What the search finds. seeds: node and place, numbers from 0 on."""
    cap, most = (NO_LIMIT if x is None else x for x in (budget.neighbours, budget.edges))
    most_nodes, most_results = (NO_LIMIT if x is None else x for x in (budget.nodes, budget.results))
    kind = links.schema["source"].dataType.simpleString()
    links, nodes = written(links, "links"), written(nodes, "nodes")
    first = seeds.join(nodes, "node").select("node", "result", F.lit(0).alias("depth"), F.col("place").cast("long").alias("place"), F.lit(None).cast(kind).alias("parent"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("int").alias("direction"), F.array("node").alias("path"))
    seen = frontier = written(first, "search")
    figures = frontier.agg(F.count(F.lit(1)), F.count_if("result")).first()
    visited, results, examined, limited, offset = figures[0], figures[1], 0, False, figures[0]
    for depth in range(1, budget.hops + 1):
        if budget.stop and (examined >= most or visited >= most_nodes or results >= most_results):
            frontier, limited = frontier.limit(0), True
            break
        met = frontier.select("node", "place", "path").join(links.withColumnsRenamed({"relation": "link", "direction": "way"}), F.col("node") == F.col("source"))
        rank = F.row_number().over(Window.partitionBy("place").orderBy("kind", "target", "link", "way"))
        # Spark keeps a node's first links in each task before it shuffles them.
        near = met.filter(F.col("kind") != FREE).withColumn("rank", rank)
        if budget.neighbours is not None:
            near = near.filter(F.col("rank") <= budget.neighbours + 1)
        near = near.unionByName(met.filter(F.col("kind") == FREE).withColumn("rank", rank)).withColumn("free", F.col("kind") == FREE)
        over = ~F.col("free") & (F.col("rank") > cap)
        near = written(near.select("node", "place", "path", "target", "link", "way", "free", "rank", over.alias("over")), "near")
        limited = limited or not near.filter("over").isEmpty()
        edges, total = counted(running(near.filter("not over"), "place", ["free", "rank"], {"number": F.lit(1)}), "edges")
        ready = edges.filter(F.col("number") <= most - examined)
        new = ready.groupBy("target").agg(F.min(F.struct("place", "number", "node", "link", "way", "path")).alias("by"))
        new = new.join(seen.select(F.col("node").alias("target")), "target", "left_anti").join(nodes.withColumnRenamed("node", "target"), "target").select("target", "result", "by.*")
        new, offered = counted(running(new, "place", ["number"], {"held": F.col("result").cast("long"), "found": F.lit(1)}), "new")
        if budget.stop:
            kept = new.filter((F.col("found") <= most_nodes - visited) & (F.col("held") - F.col("result").cast("long") < most_results - results))
        else:
            kept = new.filter(~F.col("result") | (F.col("held") <= most_results - results)).drop("found", "held")
            kept = running(kept, "place", ["number"], {"found": F.lit(1)}).filter(F.col("found") <= most_nodes - visited)
        spot = (F.col("found") + (offset - 1)).alias("place")
        by = [F.col("node").alias("parent"), F.col("link").alias("relation"), F.col("way").alias("direction"), F.concat("path", F.array("target")).alias("path")]
        kept = written(kept.select(F.col("target").alias("node"), "result", F.lit(depth).alias("depth"), spot, *by, "number"), "search")
        figures = kept.agg(F.count(F.lit(1)), F.count_if("result"), F.max("number")).first()
        visited, results = visited + figures[0], results + figures[1]
        full = budget.stop and (visited >= most_nodes or results >= most_results)
        # With stop nothing is looked at after the edge that used up a budget; else all edges are, whether they lead on or not.
        looked = figures[2] if full else min(total, most - examined)
        limited = limited or looked < total or (not budget.stop and offered > figures[0])
        examined, offset = examined + looked, offset + figures[0]
        if budget.stop and (full or examined >= most) and not limited:
            last = edges.filter(F.col("number") == looked).agg(F.max("place")).first()[0]
            limited = not frontier.filter(F.col("place") > (-1 if last is None else last)).isEmpty()
        frontier = kept.drop("number")
        if not figures[0]:
            break
        seen = gathered(seen, frontier, depth)
    if budget.stop:
        ahead = not frontier.isEmpty()
    else:
        after = frontier.select("node").join(links, F.col("node") == F.col("source")).select("target")
        ahead = not after.join(seen.select(F.col("node").alias("target")), "target", "left_anti").isEmpty()
    return Found(seen, examined, visited, results, bool(limited), ahead)


def scored(found: Found) -> DataFrame:
    """The results with 1 / the length of their path; seeds have no such score."""
    score = F.when(F.col("depth") > 0, 1 / F.size("path"))
    return found.visited.filter("result").select("node", "depth", "place", score.alias("score"), "path")


def record(found: Found, indexed: DataFrame, budget: Budget, sample: int) -> DataFrame:
    """One row about a selection: the search's figures and what of the index (column node) it left out, with the first few."""
    spark = indexed.sparkSession
    left = indexed.join(found.visited.filter("result").select("node"), "node", "left_anti")
    few = left.orderBy("node").limit(sample).agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("omitted"))  # sample rows
    figures = spark.createDataFrame([(found.nodes, found.examined, found.limited, found.hop_limited, found.results)], "visited_nodes long, examined_edges long, limited boolean, hop_limited boolean, selected long")
    return figures.crossJoin(left.agg(F.count(F.lit(1)).alias("omitted_count"))).crossJoin(few)
