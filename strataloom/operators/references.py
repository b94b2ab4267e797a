"""Regions that selected ones refer to by label, within their document: definitions, targets and their neighbours.

Labels and references are read from every region once. A hop joins the frontier's references with the
document's labels; a label that stands in several regions, or in none, is reported and leads nowhere. What
is taken in a hop is decided in order (frontier, reference, label, target before its neighbours): as long
as there are budgets for regions and characters, one that doesn't fit is left out and the next one tried.
At most `most` regions are taken in all, so only so many candidates at a time come to the driver; without
budgets none do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

LABEL = r"\\label\s*\{([^{}]+)\}"
REFERENCE = r"\\(?:[cC]ref|[cC]pageref|eqref|ref|autoref)\*?\s*\{([^{}]+)\}"
DEFINITION = r"\\begin\s*\{definition\*?\}"
ORDER = ["frontier", "reference", "item", "side"]
INCLUDED = "region_id {id}, place long, hop int, source {id}, label string, target {id}"


@dataclass(frozen=True)
class Expansion:
    """included: region_id, place (order), hop, source, label, target; unresolved: source, label, reason; omitted: region_id."""

    included: DataFrame
    unresolved: DataFrame
    omitted: DataFrame
    hop_limited: bool


def uncommented(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)%[^\n]*", "")


def _beside(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Each row's target (document, ordinal) and the regions before and after it: candidate, size, side."""
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.lit(step).alias("step")) for i, step in enumerate((0, -1, 1))])).alias("s")
    spread = rows.select("*", sides).select(*rows.columns, F.col("s.side").alias("side"), (F.col("ordinal") + F.col("s.step")).alias("at")).drop("ordinal")
    there = places.select(F.col("document").alias("of"), F.col("ordinal").alias("spot"), F.col("region_id").alias("candidate"), "size")
    return spread.join(there, (F.col("document") == F.col("of")) & (F.col("at") == F.col("spot"))).drop("of", "spot", "at")


def expand(regions: DataFrame, selected: DataFrame, hops: int = 3, most: int | None = 24, chars: int | None = 100_000) -> Expansion:
    """regions: region_id, document, ordinal, text; selected: region_id, place (numbers from 0 on)."""
    spark = regions.sparkSession
    kind = regions.schema["region_id"].dataType.simpleString()
    bare = regions.select("region_id", "document", "ordinal", F.char_length("text").cast("long").alias("size"), uncommented(F.coalesce("text", F.lit(""))).alias("bare"))
    read = bare.select("region_id", "document", "ordinal", "size", F.regexp_extract_all("bare", F.lit(LABEL), F.lit(1)).alias("labels"), F.regexp_extract_all("bare", F.lit(REFERENCE), F.lit(1)).alias("references"), F.col("bare").rlike(DEFINITION).alias("defines"))
    read = written(read, "labels")
    places = read.select("region_id", "document", "ordinal", "size")
    labels = read.select("region_id", "document", "ordinal", F.explode("labels").alias("label")).withColumn("label", F.trim("label")).distinct()
    known = written(labels.groupBy("document", "label").agg(F.count(F.lit(1)).alias("regions"), F.min(F.struct("region_id", "ordinal")).alias("one")), "known")
    said = read.select("region_id", "document", F.posexplode("references").alias("reference", "list")).select("region_id", "document", "reference", F.posexplode(F.split("list", ",")).alias("item", "label")).withColumn("label", F.trim("label"))
    said = written(said, "references")
    chosen = written(selected.select("region_id", F.col("place").cast("long").alias("place")), "selected")
    count = chosen.count()
    seen = chosen.select("region_id")
    none = spark.createDataFrame([], INCLUDED.format(id=kind))
    included, omitted, unresolved = [none], [], []
    taken, used = 0, 0

    def admitted(offered: DataFrame, hop: int) -> DataFrame:
        """The candidates that are taken, with their place; what isn't counts as omitted."""
        nonlocal taken, used, seen
        ordered = offered.join(seen.select(F.col("region_id").alias("candidate")), "candidate", "left_anti")
        first = ordered.groupBy("candidate").agg(F.min(F.struct(*ORDER, "size", "source", "label", "target")).alias("by")).select("candidate", "by.*")
        first = written(first, "offered")
        if most is None and chars is None:
            # Order decides nothing without budgets but which reference is named as the first.
            got = written(first.select(F.col("candidate").alias("region_id"), F.lit(count).cast("long").alias("place"), F.lit(hop).alias("hop"), "source", "label", "target"), "included")
            taken += got.count()
        else:
            rows, last = [], None
            while True:
                room = (1 << 62) if most is None else most - taken
                left = (1 << 62) if chars is None else chars - used
                open_rows = first.filter(F.col("size") <= left)
                if last is not None:
                    open_rows = open_rows.filter(F.struct(*ORDER) > F.struct(*[F.lit(x).cast(first.schema[c].dataType).alias(c) for c, x in zip(ORDER, last, strict=True)]))
                batch = open_rows.orderBy(*ORDER).limit(min(room, 1000)).collect() if room > 0 else []
                if not batch:
                    break
                for row in batch:
                    last = tuple(row[c] for c in ORDER)
                    if chars is not None and used + row["size"] > chars:
                        break  # what still fits is asked for anew
                    rows.append((row["candidate"], count + taken, hop, row["source"], row["label"], row["target"]))
                    taken += 1
                    used += row["size"]
            got = spark.createDataFrame(rows, INCLUDED.format(id=kind))
        omitted.append(first.select(F.col("candidate").alias("region_id")).join(got.select("region_id"), "region_id", "left_anti"))
        seen = written(seen.unionByName(got.select("region_id")), "seen")
        included.append(got)
        return got

    documents = places.join(chosen, "region_id").select("document").distinct()
    defined = read.filter("defines").join(documents, "document", "left_semi").select("document", "ordinal", F.col("region_id").alias("target"))
    # Definitions come in order of (document, ordinal), each before its neighbours; here the document is the frontier.
    nothing = {"reference": F.col("ordinal").cast("int"), "item": F.lit(0), "source": F.lit(None).cast(kind), "label": F.lit(None).cast("string")}
    offered = _beside(defined.withColumns({"frontier": F.col("document"), **nothing}), places)
    frontier = chosen.unionByName(admitted(offered, 0).select("region_id", "place"))
    for hop in range(1, hops + 1):
        asked = frontier.select(F.col("region_id").alias("source"), F.col("place").alias("frontier")).join(said.withColumnRenamed("region_id", "source"), "source")
        asked = written(asked.join(known, ["document", "label"], "left"), "asked")
        unresolved.append(asked.filter("regions is null or regions > 1").select("source", "label", F.when(F.col("regions").isNull(), "missing").otherwise("ambiguous").alias("reason")))
        one = asked.filter("regions = 1").select("frontier", "reference", "item", "source", "label", "document", F.col("one.region_id").alias("target"), F.col("one.ordinal").alias("ordinal"))
        frontier = admitted(_beside(one, places), hop).select("region_id", "place")
        if frontier.isEmpty():
            break

    def together(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()

    lost = together(unresolved) if unresolved else spark.createDataFrame([], f"source {kind}, label string, reason string")
    return Expansion(together(included), lost, together(omitted).join(seen, "region_id", "left_anti"), not frontier.isEmpty())
