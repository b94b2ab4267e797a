"""Validation as issue tables: what is wrong with which row, the first failing rule first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .graph import sided


def first_failure(checks: Sequence[tuple[str, Column]], passed: str = "ok") -> Column:
    """The code of the first failing check, in order."""
    out = None
    for code, failing in checks:
        out = F.when(failing, code) if out is None else out.when(failing, code)
    return out.otherwise(passed)


def evidence_issues(references: DataFrame, regions: DataFrame, project: str) -> DataFrame:
    """Each reference with its first failing code: missing, scope, quality, bounds, quotation.

    References: ref_id, region, begin, end, quotation. Slices count code points.
    """
    r = regions.select(F.col("region_id").alias("region"), "text", "project_id", "quality")
    joined = references.join(r, "region", "left")
    cut = F.substring(F.col("text"), F.col("begin").cast("int") + 1, (F.col("end") - F.col("begin")).cast("int"))
    checks = [
        ("missing", F.col("text").isNull()),
        ("scope", F.col("project_id").isNotNull() & (F.col("project_id") != project)),
        ("quality", F.coalesce(F.col("quality"), F.lit("full")) != "full"),
        ("bounds", (F.col("begin") < 0) | (F.col("end") > F.length("text")) | (F.col("begin") >= F.col("end"))),
        ("quotation", cut != F.col("quotation")),
    ]
    return joined.select("ref_id", first_failure(checks).alias("code"))


def grounding(citations: DataFrame) -> DataFrame:
    """Whether a quotation stands exactly once in its text: unique, ambiguous or absent."""
    at = F.expr("locate(quotation, text)")
    again = F.expr("locate(quotation, text, locate(quotation, text) + 1)")
    return citations.select("ref_id", F.when(at == 0, "absent").when(again > 0, "ambiguous").otherwise("unique").alias("grounding"))


def endpoint_issues(edges: DataFrame, types: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges with missing endpoints or endpoint types that the relation doesn't allow."""
    t = types.select("node", "type")
    joined = edges.join(sided(t.select(F.col("node").alias("src"), F.col("type").alias("src_type"))), "src", "left").join(sided(t.select(F.col("node").alias("dst"), F.col("type").alias("dst_type"))), "dst", "left")
    known = joined.join(allowed.withColumn("fine", F.lit(True)), ["relation", "src_type", "dst_type"], "left")
    checks = [("missing_source", F.col("src_type").isNull()), ("missing_target", F.col("dst_type").isNull()), ("endpoint_mismatch", F.col("fine").isNull())]
    return known.select("src", "dst", "relation", first_failure(checks).alias("issue")).filter("issue <> 'ok'")


def overlaps(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of half-open intervals that overlap, as an equi-join on cells of a fixed width.

    left: l_id, l_begin, l_end; right: r_id, r_begin, r_end; both with group. A pair is given in the
    first cell that both touch, so once.
    """
    cells = lambda df, p: df.filter(F.col(f"{p}_begin") < F.col(f"{p}_end")).withColumn("cell", F.explode(F.sequence(F.expr(f"{p}_begin div {width}"), F.expr(f"({p}_end - 1) div {width}"))))
    both = cells(left, "l").join(cells(right, "r"), ["group", "cell"])
    first = F.greatest(F.expr(f"l_begin div {width}"), F.expr(f"r_begin div {width}"))
    return both.filter((F.col("l_begin") < F.col("r_end")) & (F.col("r_begin") < F.col("l_end")) & (F.col("cell") == first)).drop("cell")


def merged_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with endpoints mapped to canonical nodes; those equal in all but id collapse to the least id."""
    m = mapping.select("node", "canonical")
    moved = edges.join(m.select(F.col("node").alias("src"), F.col("canonical").alias("s")), "src", "left").join(m.select(F.col("node").alias("dst"), F.col("canonical").alias("t")), "dst", "left")
    return moved.select("id", "relation", F.coalesce("s", "src").alias("src"), F.coalesce("t", "dst").alias("dst")).groupBy("relation", "src", "dst").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("merged"))


def batches(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Rows of a group in batches of a size."""
    return rows.withColumn("batch", F.expr(f"(row_number() over (partition by {group} order by {order}) - 1) div {size}"))


def latest_first(rows: DataFrame, key: str, order: Column) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("rn = 1").drop("rn")


def reference_codes(references: DataFrame, regions: DataFrame, sources: DataFrame, artifacts: DataFrame, corpus: str, project: str) -> DataFrame:
    """Each reference with the first of the exact-source rules that it breaks, or ok.

    references: ref_id, corpus_id, project_id, region_id, artifact_id, content_hash, source_revision, quotation,
    ordinal, begin, end and quality (null where the locator names none); regions: the same but the hash, with
    source_id, source_artifact_id and text (the slice begin to end of its artifact); sources: source_id,
    artifact_id, source_revision, digest of its bytes; artifacts: artifact_id, digest, text. Slices count code points.
    """
    r = regions.select(*[F.col(c).alias(f"r_{c}") for c in regions.columns])
    s = sources.select(*[F.col(c).alias(f"s_{c}") for c in sources.columns])
    a = artifacts.select(*[F.col(c).alias(f"a_{c}") for c in artifacts.columns])
    joined = references.join(r, F.col("region_id") == F.col("r_region_id"), "left").join(s, F.col("r_source_id") == F.col("s_source_id"), "left").join(a, F.col("artifact_id") == F.col("a_artifact_id"), "left")
    c = F.col
    differs = lambda x, y: ~c(x).eqNullSafe(c(y))
    wrong = lambda x: c(x).isNotNull() & differs(x, f"r_{x}")
    inside = (c("r_begin") >= 0) & (c("r_begin") < c("r_end")) & (c("r_end") <= F.length("a_text"))
    cut = F.substring(c("a_text"), c("r_begin").cast("int") + 1, (c("r_end") - c("r_begin")).cast("int"))
    checks = [
        ("scope_mismatch", (c("corpus_id") != corpus) | (c("project_id").isNotNull() & (c("project_id") != project))),
        ("region_missing", c("r_region_id").isNull() | (c("r_corpus_id") != corpus)),
        ("scope_mismatch", (c("r_project_id").isNotNull() & (c("r_project_id") != project)) | differs("project_id", "r_project_id")),
        ("quality_label_missing", (c("r_quality") == "fast_provisional") & ~c("quality").eqNullSafe(F.lit("fast_provisional"))),
        ("source_mismatch", c("s_source_id").isNull() | differs("s_source_revision", "r_source_revision")),
        ("source_mismatch", c("s_artifact_id") != F.coalesce("r_source_artifact_id", "r_artifact_id")),
        ("hash_mismatch", differs("s_digest", "s_artifact_id")),
        ("artifact_missing", c("a_artifact_id").isNull()),
        ("hash_mismatch", differs("a_digest", "content_hash")),
        ("revision_mismatch", differs("r_artifact_id", "artifact_id") | differs("r_source_revision", "source_revision")),
        ("region_mismatch", ~F.coalesce(inside & (cut == c("r_text")), F.lit(False))),
        ("quotation_mismatch", c("quotation").isNotNull() & differs("quotation", "r_text")),
        ("locator_mismatch", wrong("begin") | wrong("end") | wrong("ordinal")),
        ("locator_mismatch", wrong("quality")),
    ]
    return joined.select("ref_id", first_failure(checks).alias("code"))


def binding_issues(regions: DataFrame, sources: DataFrame) -> DataFrame:
    """Regions that don't bind to their source's descriptor, with the first rule broken.

    regions: region_id, source_id, project_id, source_revision, artifact_id, source_artifact_id; sources (a row
    a source): source_id, project_id, source_revision, artifact_id.
    """
    s = sources.select(*[F.col(c).alias(f"s_{c}") for c in ("source_id", "project_id", "source_revision", "artifact_id")])
    joined = regions.join(s, F.col("source_id") == F.col("s_source_id"), "left")
    checks = [
        ("unknown_source", F.col("s_source_id").isNull()),
        ("project", F.col("s_project_id").isNotNull() & ~F.col("s_project_id").eqNullSafe(F.col("project_id"))),
        ("revision", F.col("s_source_revision") != F.col("source_revision")),
        ("artifact", F.col("s_artifact_id") != F.coalesce("source_artifact_id", "artifact_id")),
    ]
    return joined.select("region_id", first_failure(checks).alias("issue")).filter("issue <> 'ok'")


def relation_issues(relations: DataFrame, citations: DataFrame, regions: DataFrame) -> DataFrame:
    """Relations (relation_id, kind, direction) with their first broken rule and what of their citations is in the text.

    An analogy establishes no direction, an equivalence candidate both; a quotation of citations (relation_id,
    region, quotation) stands in its region's text. A relation without citations is fine, but not attributed.
    """
    texts = regions.select(F.col("region_id").alias("region"), "text")
    found = F.coalesce(F.contains("text", F.col("quotation")), F.lit(False))
    cited = citations.join(texts, "region", "left").groupBy("relation_id").agg(F.count(F.lit(1)).alias("citations"), F.count_if(~found).alias("absent"))
    n = F.coalesce("citations", F.lit(0))
    checks = [
        ("analogy_direction", (F.col("kind") == "analogy") & (F.col("direction") != "neither_established")),
        ("equivalence_direction", (F.col("kind") == "equivalence_candidate") & (F.col("direction") != "both_directions")),
        ("citation_absent", F.coalesce("absent", F.lit(0)) > 0),
        ("not_attributed", n == 0),
    ]
    return relations.join(cited, "relation_id", "left").select("relation_id", n.alias("citations"), first_failure(checks).alias("issue"))


def envelope_issues(entries: DataFrame, envelopes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Registry entries against the envelopes they name and the stored bytes: the first disagreement, or ok.

    entries: artifact_id, corpus_id, project_id, content_hash, source_revision, envelope_id; envelopes: envelope_id
    and the same; artifacts: artifact_id, digest.
    """
    same = ("corpus_id", "project_id", "artifact_id", "content_hash", "source_revision")
    e = envelopes.select("envelope_id", *[F.col(c).alias(f"e_{c}") for c in same])
    joined = entries.join(e, "envelope_id", "left").join(artifacts.select("artifact_id", "digest"), "artifact_id", "left")
    differ = ~F.col("corpus_id").eqNullSafe(F.col("e_corpus_id"))
    for c in same[1:]:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"e_{c}"))
    checks = [
        ("no_envelope_binding", F.col("envelope_id").isNull()),
        ("envelope_unavailable", F.col("e_artifact_id").isNull()),
        ("binding_differs", differ),
        ("bytes_unavailable", F.col("digest").isNull()),
        ("integrity", (F.col("digest") != F.col("artifact_id")) | (F.col("digest") != F.col("content_hash"))),
    ]
    return joined.select("envelope_id", "artifact_id", first_failure(checks).alias("code"))


def finding_issues(findings: DataFrame, entries: DataFrame, codes: DataFrame) -> DataFrame:
    """Findings (finding_id, entry, ref_id: a row for each entry that one names) that don't bind.

    unknown_entry: names an entry that isn't in the snapshot (entries: entry); invalid_evidence: its reference has
    another code than ok, or none (codes: ref_id, code).
    """
    known = entries.select("entry").distinct().withColumn("known", F.lit(True))
    grouped = findings.join(known, "entry", "left").groupBy("finding_id", "ref_id").agg(F.count_if(F.col("known").isNull()).alias("unknown"), F.count(F.lit(1)).alias("entries"))
    checks = [("unknown_entry", F.col("unknown") > 0), ("invalid_evidence", ~F.col("code").eqNullSafe(F.lit("ok")))]
    return grouped.join(codes, "ref_id", "left").select("finding_id", "entries", first_failure(checks).alias("issue")).filter("issue <> 'ok'")


def gates(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Whether an answer may be final: a row a gate with the number of nodes that block it.

    nodes: node_id, role, status; reached: node, what the target rests on, itself with depth 0.
    """
    n = nodes.join(sided(reached.select(F.col("node").alias("node_id"), "depth")), "node_id", "left")
    due, target = F.col("role") == "obligation", F.col("depth") == 0
    blocking = {
        "target_is_claim": F.when(F.count_if(target & ~due) == 1, 0).otherwise(1),
        "nothing_refuted": F.count_if(F.col("status").isin("refuted", "contradicted")),
        "has_obligation": F.when(F.count_if(due) == 0, 1).otherwise(0),
        "obligations_reached": F.count_if(due & F.col("depth").isNull()),
        "obligations_resolved": F.count_if(due & ~F.col("status").isin("verified", "supported")),
    }
    counts = n.agg(*[c.cast("long").alias(g) for g, c in blocking.items()])
    rows = counts.select(F.explode(F.create_map(*[x for g in blocking for x in (F.lit(g), F.col(g))])).alias("gate", "blocking"))
    return rows.withColumn("passed", F.col("blocking") == 0)


def covering(candidates: DataFrame, lengths: DataFrame, most: int = 20_000, size: int = 32) -> DataFrame:
    """Shortest-first chains of slices that cover a text: per key the slices, their batches and how it ended.

    candidates: key, begin, end; lengths: key, length. At a position the shortest slice of at most so many characters
    that begins there is next; a position without one is a gap. Each text's next position is a pointer, so chains
    of any length are followed by doubling: one more round where they are twice as long.
    """
    fit = candidates.filter((F.col("end") > F.col("begin")) & (F.col("end") - F.col("begin") <= most))
    jump = written(fit.groupBy("key", "begin").agg(F.min("end").alias("to"), F.lit(1).cast("long").alias("steps")), "jump")
    at = written(lengths.select("key", F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("place")), "at")
    while not jump.isEmpty():
        ahead = at.join(jump, ["key", "begin"]).select("key", F.col("to").alias("begin"), (F.col("place") + F.col("steps")).alias("place"))
        at = written(at.unionByName(ahead), "at")
        second = jump.select("key", F.col("begin").alias("to"), F.col("to").alias("last"), F.col("steps").alias("more"))
        jump = written(jump.join(second, ["key", "to"]).select("key", "begin", F.col("last").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), "jump")
    ends = at.groupBy("key").agg(F.max("begin").alias("reached"), F.max("place").alias("slices"))
    status = F.when(F.col("reached") >= F.col("length"), "complete").otherwise("gap")
    return lengths.join(ends, "key").select("key", "slices", F.expr(f"(slices + {size - 1}) div {size}").alias("batches"), "reached", status.alias("status"))


def merged_nodes(nodes: DataFrame, edges: DataFrame, mapping: DataFrame, text: str) -> DataFrame:
    """Canonical nodes: how many members, the union of a column's values, and the distinct nodes that they now rest on.

    The column has few distinct values; edges (src, dst) inside a canonical node drop.
    """
    m = mapping.select(F.col("node").alias("node_id"), "canonical")
    members = nodes.join(m, "node_id").groupBy("canonical").agg(F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_set(text)), ",").alias(text))
    moved = edges.join(m.select(F.col("node_id").alias("src"), F.col("canonical").alias("s")), "src").join(m.select(F.col("node_id").alias("dst"), F.col("canonical").alias("t")), "dst")
    below = moved.filter("s <> t").select(F.col("s").alias("canonical"), "t").distinct().groupBy("canonical").agg(F.count(F.lit(1)).alias("parents"))
    return members.join(below, "canonical", "left").withColumn("parents", F.coalesce("parents", F.lit(0)))


def extraction_delta(raw: DataFrame, relations: DataFrame) -> DataFrame:
    """The delta that extracted documents (object_id, json) make: nodes to upsert and edges to add, each with an issue.

    The JSON has components and obligations (lists of ids) and relations (subject_id, predicate, object_id). relations
    names the allowed (relation, src_type, dst_type). Columns: action, id, type, target, issue; each row once.
    """
    schema = "components array<string>, obligations array<string>, relations array<struct<subject_id string, predicate string, object_id string>>"
    x = raw.select(F.from_json("json", schema).alias("x")).select("x.*")
    row = lambda id, type, target: F.struct(id.alias("id"), type.alias("type"), target.alias("target"))
    of = lambda field, kind: F.transform(F.coalesce(field, F.array().cast("array<string>")), lambda i: row(i, F.lit(kind), F.lit(None).cast("string")))
    between = F.transform(F.coalesce("relations", F.array().cast("array<struct<subject_id string, predicate string, object_id string>>")), lambda r: row(r["subject_id"], r["predicate"], r["object_id"]))
    tagged = lambda rows, edge: F.transform(rows, lambda r: F.struct(F.lit(edge).alias("edge"), r["id"].alias("id"), r["type"].alias("type"), r["target"].alias("target")))
    # The documents are parsed once; what they hold is written, each row once.
    every = F.concat(tagged(of("components", "component"), False), tagged(of("obligations", "obligation"), False), tagged(between, True))
    found = written(x.select(F.explode(F.array_distinct(every)).alias("r")).select("r.*").distinct(), "extracted")
    types = found.filter("not edge").select(F.col("id").alias("node"), "type")
    links = found.filter("edge").select(F.col("id").alias("src"), F.col("type").alias("relation"), F.col("target").alias("dst"))
    issues = links.join(endpoint_issues(links, types, relations), ["src", "dst", "relation"], "left")
    edges = issues.select(F.lit("add_edge").alias("action"), F.col("src").alias("id"), F.col("relation").alias("type"), F.col("dst").alias("target"), F.coalesce("issue", F.lit("ok")).alias("issue"))
    return types.select(F.lit("upsert_node").alias("action"), F.col("node").alias("id"), "type", F.lit(None).cast("string").alias("target"), F.lit("ok").alias("issue")).unionByName(edges)


def coverage(found: DataFrame, required: DataFrame) -> DataFrame:
    """What of the required types (column type, few) each group of found (group, type) lacks."""
    every = required.select("type").distinct().agg(F.array_sort(F.collect_list("type")).alias("every"))
    had = found.groupBy("group").agg(F.collect_set("type").alias("had"))
    lacks = F.array_except("every", "had")
    return had.crossJoin(F.broadcast(every)).select("group", F.size("had").cast("long").alias("types"), F.size(lacks).cast("long").alias("missing"), F.array_join(lacks, ",").alias("lacks"))


def submission_codes(submissions: DataFrame, nodes: DataFrame, open_roots: DataFrame) -> DataFrame:
    """Whether submitted answers are what their support nodes hold, and how many open roots those rest on.

    submissions: id, support, answer; nodes: node_id, status, value; open_roots: src, dst (each pair once).
    """
    roots = open_roots.groupBy(F.col("src").alias("support")).agg(F.count(F.lit(1)).alias("unresolved"))
    joined = submissions.join(nodes.select(F.col("node_id").alias("support"), "status", "value"), "support", "left").join(roots, "support", "left")
    checks = [("unknown_or_failed", F.col("status").isNull() | F.col("status").isin("failed", "proposed")), ("differs", ~F.col("answer").eqNullSafe(F.col("value")))]
    rows = joined.select("id", "support", "status", F.coalesce("unresolved", F.lit(0)).alias("unresolved"), first_failure(checks, "bound").alias("code"))
    ready = (F.col("code") == "bound") & (F.col("unresolved") == 0) & F.col("status").isin("verified", "observed")
    return rows.withColumn("ready", ready).drop("status")
