"""Parsing and folding of raw documents. Python runs per row, small helpers over Arrow batches."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .graph import counted, gathered, sided, turns

SKIPPED = {"script", "style", "nav", "footer", "head", "noscript"}
BREAKS = {"p", "div", "li", "tr", "br", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol"}
#: Most characters of a chunk, and where the earliest cut at white space may be.
MOST, EARLIEST = 1800, 900


#: What a tag puts into a page's text, at its start; headings and lists of Markdown only there.
STARTS = dict.fromkeys(BREAKS, "\n")
HEADINGS = {f"h{n}": "\n" + "#" * n + " " for n in range(1, 7)}


#: Rows of an Arrow batch that are parsed before their results are handed on.
SLICE = 128


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that a task holds the Python objects of few rows at a time, however many a batch has."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


class Visible(HTMLParser):
    """The visible text of a page; with markdown, headings as #, links as [text](target) and images as ![alt]."""

    def __init__(self, markdown: bool):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.targets: list[str] = []
        self.depth = 0  # of tags whose text isn't seen
        self.markdown = markdown
        self.starts = STARTS | HEADINGS if markdown else STARTS

    def handle_starttag(self, tag, attrs):
        self.depth += tag in SKIPPED
        self.out.append(self.starts.get(tag, ""))
        given = dict(attrs)
        if self.markdown and tag == "a":
            self.targets.append(given.get("href") or "")
            self.out.append("[")
        if self.markdown and tag == "img" and not self.depth:
            self.out.append(f"![{given.get('alt') or ''}]")

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in SKIPPED))
        self.out.append(STARTS.get(tag, ""))
        if tag == "a" and self.targets:
            self.out.append(f"]({self.targets.pop()})")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def visible_text(html: str | None, markdown: bool) -> str:
    parser = Visible(markdown)
    parser.feed(html or "")
    parser.close()
    text = "".join(parser.out)
    return re.sub(r"\n\s*\n+", "\n\n", re.sub(r"[ \t]+", " ", text)).strip() if markdown else " ".join(text.split())


def html_text(pages: DataFrame, markdown: bool) -> DataFrame:
    """page_id and text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            text = pa.array([visible_text(h, markdown) for h in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), text], names=["page_id", "text"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, text string")


FORMULA = re.compile(r"(?P<display>\$\$.+?\$\$)|(?P<bracket>\\\[.+?\\\])|(?P<inline>\$[^$\n]+\$)", re.S)


def formula_spans(regions: DataFrame) -> DataFrame:
    """Offsets of TeX formulas: region_id, begin, end, kind."""

    kinds = pa.schema([("region_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [(r, m.start(), m.end(), m.lastgroup) for r, t in zip(b.column("region_id").to_pylist(), b.column("text").to_pylist(), strict=True) for m in FORMULA.finditer(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

    return regions.select(F.col("region_id").cast("long"), "text").mapInArrow(run, "region_id long, begin long, end long, kind string")


class Members(list):
    """The (name, value) pairs of a JSON object, repeated names included."""


def strict(text: str | None) -> bool:
    """Whether a text is one JSON object without repeated names, NaN or infinities, at any depth."""
    try:
        whole = json.loads(text or "", object_pairs_hook=Members)
    except ValueError:
        return False
    todo = [whole]
    while todo:
        value = todo.pop()
        if isinstance(value, Members):
            if len(dict(value)) < len(value):
                return False
            todo += [v for _, v in value]
        elif isinstance(value, list):
            todo += value
        elif isinstance(value, float) and not math.isfinite(value):
            return False
    return isinstance(whole, Members)


def strict_json(rows: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "valid": [strict(p) for p in f["payload"]]})

    return rows.select("id", "payload").mapInPandas(run, "id long, valid boolean")


def leaves(payload: str | None) -> list[tuple[str, str]]:
    """Paths of a JSON text's scalar leaves with their JSON, names in order; empty objects and lists have none."""
    found, todo = [], [((), json.loads(payload))] if payload else []
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict | list):
            inner = sorted(value.items()) if isinstance(value, dict) else list(enumerate(value))
            todo += [((*path, str(k)), v) for k, v in reversed(inner)]
        else:
            found.append((".".join(path), json.dumps(value)))
    return found


def json_leaves(rows: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(i, *x) for i, p in zip(f["id"], f["payload"], strict=True) for x in leaves(p)]
            yield pd.DataFrame(found, columns=["id", "path", "value"])

    return rows.select("id", "payload").mapInPandas(run, "id long, path string, value string")


def cut(text: str) -> list[tuple[int, int]]:
    """Ranges of at most MOST characters that cover a text, cut after white space where there is any late enough."""
    out, at = [], 0
    while at < len(text):
        end = min(at + MOST, len(text))
        if end < len(text):
            space = max(text.rfind(c, at + EARLIEST, end) for c in " \n\t")
            end = space + 1 if space >= 0 else end
        out.append((at, end))
        at = end
    return out


def chunks(regions: DataFrame) -> DataFrame:
    """region_id, ordinal, begin, end and text of each chunk; the chunks of a region make its text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r, n, a, b, t[a:b]) for r, t in zip(f["region_id"], f["text"].fillna(""), strict=True) for n, (a, b) in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=["region_id", "ordinal", "begin", "end", "text"])

    return regions.select("region_id", "text").mapInPandas(run, "region_id long, ordinal long, begin long, end long, text string")


def cursor_pages(rows: DataFrame, key: str, value: str, budget: int) -> DataFrame:
    """Pages of at most so many bytes by running size within each block of keys, with an opaque cursor."""
    block = F.col(key).cast("long") - F.col(key).cast("long") % 1000
    used = F.sum(F.octet_length(value)).over(Window.partitionBy("block").orderBy(key))
    page = F.concat(F.col("block"), F.lit("/"), F.expr(f"used div {budget}"))
    return rows.withColumn("block", block).withColumn("used", used).withColumn("page", page).withColumn("cursor", F.base64(F.encode(F.concat("page", F.lit("@"), key), "UTF-8")))


#: Keys of a range in which rows are numbered, and rows that are looked at together for page breaks.
RANGE, TOGETHER = 4096, 1024


def dense(rows: DataFrame, group: str, key: str) -> DataFrame:
    """rows with n, their number in the group in order of a unique whole key, from 0: in ranges of keys first, then the ranges' sums."""
    ranged = rows.withColumn("range", F.expr(f"{key} div {RANGE}"))
    before = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = ranged.groupBy(F.col(group).alias("of"), F.col("range").alias("at")).agg(F.count(F.lit(1)).alias("count"))
    starts = counts.select("of", "at", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(group, "range").orderBy(key)) - 1
    return ranged.withColumn("inside", inside).join(starts, F.col(group).eqNullSafe(F.col("of")) & (F.col("range") == F.col("at"))).withColumn("n", F.col("start") + F.col("inside")).drop("range", "of", "at", "start", "inside")


def budget_pages(rows: DataFrame, session: str, key: str, size: str, budget: int, limit: int, revision: int) -> DataFrame:
    """Pages of a session's rows in order: as many as fit the budget, at most limit, at least one: session, key, page, offset, cursor.

    Where a page ends depends on where it begins, so breaks are sequential. But each row knows where a page
    would end that begins with it, from the next few rows alone. A block of rows is entered at one of its
    first limit rows; where it is left from each of these is found in the block, and only those pointers are
    followed by doubling: one more round where there are twice as many blocks. cursor leads to the next page
    of this session and revision; the last page has none.
    """
    block = max(TOGETHER, limit)
    numbered = dense(rows.select(session, key, F.col(size).cast("long").alias("size")), session, key)
    # Blocks of rows, each with the first rows of the next one.
    own = F.expr(f"n div {block}")
    spread = numbered.withColumn("block", F.explode(F.when((own > 0) & (F.col("n") % block < limit), F.array(own, own - 1)).otherwise(F.array(own))))
    ahead = Window.partitionBy(session, "block").orderBy("n").rowsBetween(Window.currentRow, limit - 1)
    sums = F.aggregate(F.collect_list("size").over(ahead), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("fit"), F.lit(True).alias("on")), lambda a, x: F.struct(
        (a["sum"] + x).alias("sum"), (a["fit"] + (a["on"] & ((a["sum"] + x <= budget) | (a["fit"] == 0))).cast("int")).alias("fit"), (a["on"] & ((a["sum"] + x <= budget) | (a["fit"] == 0))).alias("on")))
    pointed = spread.withColumn("to", F.col("n") + sums["fit"]).filter(F.col("block") == own)
    held = F.array_sort(F.collect_list(F.struct("n", F.col(key).alias("key"), "to")))
    blocks = pointed.groupBy(session, "block").agg(held.alias("held"))
    blocks = written(blocks.select(F.col(session).alias("of"), "block", (F.col("block") * block).alias("start"), F.col("held.key").alias("keys"), F.col("held.to").alias("to")), "blocks")
    kind, keys = (rows.schema[c].dataType.simpleString() for c in (session, key))

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = [(at, *x) for at, start, to in zip(range(b.num_rows), b.column("start").to_pylist(), b.column("to").to_pylist(), strict=True) for x in passed(start, to, limit)]
            columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column("of").take(columns[0]), *columns[1:]], names=["of", "n", "to", "steps", "last"])

    first = jump = written(blocks.select("of", "start", "to").mapInArrow(through, f"of {kind}, n long, to long, steps long, last long"), "jump")
    at = written(blocks.filter("block = 0").select("of", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("page")), "at")
    jump = jump.drop("last")
    while not jump.isEmpty():
        ahead = jump.select(F.col("of").alias("same"), F.col("n").alias("mid"), F.col("to").alias("further"), F.col("steps").alias("more"))
        on = at.join(sided(ahead), F.col("of").eqNullSafe(F.col("same")) & (F.col("n") == F.col("mid"))).select("of", F.col("further").alias("n"), (F.col("page") + F.col("more")).alias("page"))
        at = written(at.unionByName(on), "at")
        jump = written(jump.join(sided(ahead), F.col("of").eqNullSafe(F.col("same")) & (F.col("to") == F.col("mid"))).select("of", "n", F.col("further").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), "jump")
    # Where a block is entered, the page that begins there, and where the page before it began.
    left = first.select(F.col("of").alias("same"), F.col("n").alias("mid"), F.col("to").alias("entry"), "last")
    before = at.join(sided(left), F.col("of").eqNullSafe(F.col("same")) & (F.col("n") == F.col("mid"))).select(F.col("of").alias("same"), "entry", "last")
    entered = at.join(sided(before), F.col("of").eqNullSafe(F.col("same")) & (F.col("n") == F.col("entry")), "left").select(F.col("of").alias("same"), F.struct(F.col("n").alias("entry"), "page", "last").alias("way"))
    entered = entered.groupBy("same", F.expr(f"way.entry div {block}").alias("at")).agg(F.min("way").alias("way")).select("same", "at", "way.*")  # the group's end may lie there too
    total = blocks.groupBy(F.col("of").alias("all")).agg(F.sum(F.size("keys")).alias("total"))
    whole = blocks.join(sided(entered), F.col("of").eqNullSafe(F.col("same")) & (F.col("block") == F.col("at"))).select("of", "start", "keys", "to", "entry", "page", "last")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            columns = [b.column(c).to_pylist() for c in ("start", "to", "entry", "page", "last")]
            out = [(at, *x) for at, *row in zip(range(b.num_rows), *columns, strict=True) for x in paged(*row)]
            places = [pa.array([r[i] for r in out], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("of").take(places[0]), b.column("keys").flatten(), *places[1:]], names=["of", "key", "page", "offset", "next"])

    rows = whole.mapInArrow(opened, f"of {kind}, key {keys}, page long, offset long, next long").join(sided(total), F.col("of").eqNullSafe(F.col("all")))
    token = F.to_json(F.struct(F.col("next").alias("offset"), F.lit(revision).cast("long").alias("revision"), F.col("of").alias("session_id")))
    return rows.select(F.col("of").alias(session), F.col("key").alias(key), "page", "offset", F.when(F.col("next") < F.col("total"), F.base64(F.encode(token, "UTF-8"))).alias("cursor"))


def passed(start: int, to: list[int], limit: int) -> list[tuple[int, int, int, int]]:
    """For each row of a block in which a page of the block before may end: the row, the first page start after the
    block, the pages that begin in the block on the way there, and the start of the last of them."""
    end, ways = start + len(to), [(0, 0, 0)] * len(to)
    for i in range(len(to) - 1, -1, -1):
        out, pages, last = ways[to[i] - start] if to[i] < end else (to[i], 0, start + i)
        ways[i] = (out, pages + 1, last)
    return [(start + i, *ways[i]) for i in range(min(limit, len(to)) if start else 1)]


def paged(start: int, to: list[int], entry: int, page: int, last: int | None) -> list[tuple[int, int, int]]:
    """Page, offset and next page's offset of each row of a block that page enters at entry; last began the page before."""
    out, offset, after, page = [], last, entry, page - 1
    for n in range(start, start + len(to)):
        if n == after:
            offset, after, page = n, to[n - start], page + 1
        out.append((page, offset, after))
    return out


LINKS = 1000


def hash_chain(rows: DataFrame, group: str, order: str, value: str, levels: int | None = None) -> DataFrame:
    """Head of each group's hash chain: each link hashes the last one with the row's own hash.

    A chain is sequential, so it is folded in blocks of LINKS orders, the blocks' heads in blocks of
    blocks, and so on to one head a group: no array holds more than LINKS hashes. With levels, the last of
    so many folds whatever blocks are left: with two, a group's array holds a hash for each LINKS orders.
    The order is unique in its group and not negative.
    """
    fold = lambda c: F.aggregate(F.transform(F.array_sort(c), lambda x: x["h"]), F.lit(""), lambda a, x: F.sha2(F.concat(a, x), 256))
    block = lambda df: df.groupBy(group, F.expr(f"o div {LINKS}").alias("o")).agg(fold(F.collect_list(F.struct("o", "h"))).alias("h"))
    heads = block(rows.select(group, F.col(order).alias("o"), F.sha2(value, 256).alias("h")))
    if levels is not None:
        for _ in range(2, levels):
            heads = block(heads)
        return heads.groupBy(group).agg(fold(F.collect_list(F.struct("o", "h"))).alias("generation"))
    last = (rows.agg(F.max(order)).first()[0] or 0) // LINKS
    while True:
        heads, last = block(heads), last // LINKS
        if not last:
            return heads.select(group, F.col("h").alias("generation"))


def fingerprints(edges: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """Hash of each node's own content and its dependencies' fingerprints, level by level from the leaves.

    A count of unmet dependencies tells which nodes are ready, so a round looks only at edges to new prints
    and from ready nodes. Nodes that depend on a cycle have no fingerprint.
    """
    own = nodes.select("node_id", F.sha2(F.concat_ws("|", "node_id", "role", "status"), 256).alias("own"))
    e = written(edges.select("src", "dst").distinct().join(own.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst"), "edges")
    own = written(own, "own")
    new, count = counted(own.join(sided(e.select(F.col("src").alias("node_id"))), "node_id", "left_anti").select("node_id", F.col("own").alias("print")), "prints")
    done = new
    unmet = written(e.groupBy("src").agg(F.count(F.lit(1)).alias("unmet")), "unmet")
    for turn in turns(most):
        met = e.join(sided(new.select(F.col("node_id").alias("dst")), count), "dst").groupBy("src").agg(F.count(F.lit(1)).alias("met"))
        unmet = written(unmet.filter("unmet > 0").join(sided(met), "src", "left").select("src", (F.col("unmet") - F.coalesce("met", F.lit(0))).alias("unmet")), "unmet")
        asked = e.join(sided(unmet.filter("unmet = 0").select("src")), "src", "left_semi").select("src", F.col("dst").alias("node_id"))
        below = asked.join(sided(done), "node_id").groupBy(F.col("src").alias("node_id")).agg(F.concat_ws("", F.array_sort(F.collect_list("print"))).alias("below"))
        new, count = counted(own.join(sided(below), "node_id").select("node_id", F.sha2(F.concat("own", "below"), 256).alias("print")), "prints")
        if not count:
            return done
        done = gathered(done, new, turn)
    raise RuntimeError("more levels than allowed")
