"""Operator 2: removal of repeated strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in its own text or
another; matches never cross texts.

1. Which suffixes can have a twin. Every LENGTH-byte window has an anchor: the first least hash of its
   GRAM-byte strings. Equal windows have equal anchors at the same offset, so windows whose anchor
   string occurs once are unique. The windows of one anchor lie in its context, REACH bytes to the left
   and LENGTH to the right.
2. Contexts that occur twice are covered whole; this is an aggregate over (anchor, context) hashes.
3. Different contexts of one anchor string meet in a block. Blocks are sorted one suffix bucket (one
   window column of the aligned contexts) at a time, by the first word, then by the precomputed rank of
   the next position in the difference cover, which resolves ties over the following 192 bytes, then
   by the last word. Neighbours that agree in all are twins. An anchor string with more than BLOCK
   contexts isn't sorted in a block: its windows are counted by hash in a distributed aggregate.
4. Covered ranges are joined to the texts and cut out.

Texts are never compared in pairs and no group is collected whole. Hashes have 64 bits; a context's
identity is its anchor's and its own, 128 bits.

Defined results: a null text counts as empty, nothing is removed from it; repeated rows are texts of
their own, and so copies; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as tn
from .common import ROW, column, documents, numbered, written

LENGTH, GRAM = 200, 40
REACH = LENGTH - GRAM  # bytes of a context left of its anchor
#: The difference cover's period, the stride of a context in a block (a multiple), and a block's contexts.
PERIOD, STRIDE, BLOCK = 32, 384, 20_000
SLICE = 1 << 20
#: A context with more than one in HOT of all anchors isn't joined in one task.
HOT = 1000
_U = np.uint64


def difference_cover(period: int = PERIOD, gap: int = 8) -> list[int]:
    """Residues so that each difference modulo the period is one of two of them, no further apart than gap."""
    cover = list(range(0, period, gap))
    while missing := {d for d in range(period)} - {(a - b) % period for a in cover for b in cover}:
        cover.append(max(set(range(period)) - set(cover), key=lambda r: (len(missing & ({(r - c) % period for c in cover} | {(c - r) % period for c in cover})), -r)))
    return sorted(cover)


COVER = difference_cover()


#: A factor for each 8 bytes of a string: odd, and not powers of one number.
FACTORS = tn.mix(np.arange(1, LENGTH // 8 + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)


def string_hashes(eights: np.ndarray, length: int) -> np.ndarray:
    """A hash of the string of a length, a multiple of 8, at each place; eights[..., i] are the 8 bytes from place i on."""
    places = eights.shape[-1] - length + 8
    mixed = tn.mix(eights + _U(0x2545F4914F6CDD1D))
    total = np.zeros((*eights.shape[:-1], places), dtype=np.uint64)
    for k in range(length // 8):
        total += mixed[..., 8 * k : 8 * k + places] * FACTORS[k]
    return tn.mix(total)


def anchors(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Anchors of all texts: text, place in it, bytes to the left and right in the context, string hash, context hash."""
    raw, at = tn.data(texts)
    n = len(raw)
    none = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < LENGTH:
        return none
    gram = string_hashes(tn.eights(raw)[: n - 7], GRAM)
    # The first least string of each window, by doubling the width.
    least, place, width = gram, np.arange(len(gram), dtype=np.int32), 1
    while width < REACH + 1:
        step = min(width, REACH + 1 - width)
        later = least[step:] < least[: len(least) - step]
        place = np.where(later, place[step:], place[: len(place) - step])
        least = np.where(later, least[step:], least[: len(least) - step])
        width += step
    whole = np.zeros(n - LENGTH + 2, dtype=np.int64)  # windows inside one text
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a >= LENGTH:
            whole[a] += 1
            whole[b - LENGTH + 1] -= 1
    chosen = np.zeros(len(gram), dtype=bool)
    chosen[place[np.cumsum(whole[:-1]) > 0]] = True
    p = np.flatnonzero(chosen)
    text = np.searchsorted(at, p, side="right") - 1
    left, right = np.minimum(REACH, p - at[text]), np.minimum(LENGTH, at[text + 1] - p)
    context = tn.hashed(raw, p - left, p + right) ^ tn.mix((left * 256 + right).astype(np.uint64) + _U(1))
    return text, p - at[text], left, right, gram[p], context


ANCHORS = f"{ROW} long, place long, gram long, context long"


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each anchor's row, its place (with the context's sides), its string's and its context's hash."""
    for batch in batches:
        column, row = tn.as_text(batch.column("text")), batch.column(ROW).to_numpy()
        for a, b in tn.slices(column, SLICE):
            text, place, left, right, gram, context = anchors(column.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array(row[a + text]), pa.array(place << 16 | left << 8 | right), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], names=[ROW, "place", "gram", "context"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that are asked of each text, a batch for every 10,000 of them at most."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "gram", "many", ROW, "place", "bytes"])

    rows: list[tuple] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row, raw = batch.column(ROW)[i].as_py(), batch.column("text")[i].as_py().encode()
            for x in batch.column("asked")[i].as_py():
                at, left, right = x["place"] >> 16, x["place"] >> 8 & 255, x["place"] & 255
                rows.append((x["block"], x["gram"], x["many"], row, x["place"], raw[at - left : at + right]))
                if len(rows) == 10_000:
                    yield batch_of(rows)
                    rows = []
    if rows:
        yield batch_of(rows)


def laid_out(contexts: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts as rows with their anchors in column REACH; first and last column at which a window begins."""
    left, right = place >> 8 & 255, place & 255
    out = np.zeros((len(contexts), STRIDE + 8), dtype=np.uint8)
    for r, (c, a) in enumerate(zip(contexts, (REACH - left).tolist(), strict=True)):
        out[r, a : a + len(c)] = np.frombuffer(c, np.uint8)
    return out, REACH - left, REACH + right - LENGTH


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows by their keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def twins(block: np.ndarray, group: np.ndarray, many: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which windows (context x column) have a twin: in another context of the group, or as the context occurs twice.

    group: a context's anchor string; many: whether the context occurs more than once.
    """
    word = lambda c: block[:, c : c + 8].copy().view(">u8")[:, 0]
    columns = REACH + 1
    sampled = [c for c in range(columns + PERIOD) if c % PERIOD in COVER]
    # Ranks of the cover sample: 32, 64, 128, then 192 bytes deep, by doubling; a rank is within its column.
    deep: dict[tuple[int, int], np.ndarray] = {}

    def rank(c: int, depth: int) -> np.ndarray:
        if (found := deep.get((c, depth))) is None:
            if depth == PERIOD:
                found = _rank(*[word(c + k) for k in range(0, PERIOD, 8)])
            else:
                half = {64: 32, 128: 64, 192: 128}[depth]
                found = _rank(rank(c, half), rank(c + half, depth - half))
            deep[c, depth] = found
        return found

    out = np.zeros((len(block), columns), dtype=bool)
    for c in range(columns):
        at = np.flatnonzero((first <= c) & (c <= last))
        if len(at) < 2 and not many[at].any():
            continue
        nearest = next(s for s in sampled if s >= c)  # at most 8 on, so its 192 bytes lie in the window
        keys = (group[at], word(c)[at], rank(nearest, 192)[at], word(c + LENGTH - 8)[at])
        order = np.lexsort(keys[::-1])
        same = np.ones(len(order) - 1, dtype=bool)
        for k in keys:
            s = k[order]
            same &= s[1:] == s[:-1]
        twin = many[at][order].copy()
        twin[1:] |= same
        twin[:-1] |= same
        out[at[order], c] = twin
        for key in [k for k in deep if k[0] < c]:
            del deep[key]
    return out


def _ranges(row: np.ndarray, place: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """Byte ranges that a context's windows with a twin cover."""
    padded = np.pad(found, ((0, 0), (1, 1)))
    r, begin = np.nonzero(padded[:, 1:] & ~padded[:, :-1])
    _, end = np.nonzero(~padded[:, 1:] & padded[:, :-1])
    base = (place[r] >> 16) - REACH
    return pa.RecordBatch.from_arrays([pa.array(row[r]), pa.array(base + begin), pa.array(base + end - 1 + LENGTH)], names=[ROW, "a", "b"])


def _sorted_block(table: pa.Table) -> pa.Table:
    place, many, group = (table.column(c).to_numpy() for c in ("place", "many", "gram"))
    block, first, last = laid_out(table.column("bytes").to_pylist(), place)
    found = twins(block, group, many, first, last)
    single = ~many  # contexts that occur twice are covered whole anyway
    return pa.Table.from_batches([_ranges(table.column(ROW).to_numpy()[single], place[single], found[single])])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of each window of contexts whose anchor string is too frequent for a block."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            place = part.column("place").to_numpy()
            block, first, last = laid_out(part.column("bytes").to_pylist(), place)
            column = np.arange(REACH + 1)
            r, c = np.nonzero((first[:, None] <= column) & (column <= last[:, None]))
            eights = np.lib.stride_tricks.sliding_window_view(block, 8, axis=1).copy().view("<u8")[..., 0]
            hashed = string_hashes(eights[:, : REACH + LENGTH - 7], LENGTH)[r, c]
            names = ["gram", "many", ROW, "place"]
            yield pa.RecordBatch.from_arrays([*[part.column(n).take(pa.array(r)) for n in names], pa.array(c, pa.int32()), pa.array(hashed.view(np.int64))], names=[*names, "column", "hash"])


REMOVED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges"), strict=True):
            raw = (text or "").encode()
            kept, end, spans, removed = [], 0, 0, 0
            for x in sorted((r["a"], r["b"]) for r in (ranges.as_py() or [])):
                a, b = max(x[0], end), x[1]
                if b <= a:
                    continue
                if a > end or not spans:
                    kept.append(raw[end:a])
                    spans += 1
                removed += b - a
                end = b
            kept.append(raw[end:])
            rows.append((len(raw), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *[x.split()[0] for x in REMOVED.split(", ")]])


def covered(texts: DataFrame) -> DataFrame:
    """Ranges (__row, a, b) of bytes to remove. texts: __row, text."""
    found = written(texts.mapInArrow(_anchored, ANCHORS), "anchors")
    repeated = written(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("gram").alias("g")), "grams")
    live = written(found.join(repeated, found["gram"] == repeated["g"], "left_semi"), "live")
    groups = written(live.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(ROW, "place")).alias("at")), "contexts")
    twice = groups.filter("n > 1").select(F.col("gram").alias("g"), F.col("context").alias("c"), "n")
    equal = (F.col("gram") == F.col("g")) & (F.col("context") == F.col("c"))
    # Contexts that hold more than 1/HOT of all rows: fewer than HOT, so they are sent to the rows; the rows of all
    # others are shuffled to their contexts.
    least = live.count() / HOT
    hot = F.broadcast(twice.filter(F.col("n") > least))
    side = F.shiftright("place", 16)
    repeats = live.join(hot, equal, "left_semi").unionByName(live.join(hot, equal, "left_anti").join(twice.filter(F.col("n") <= least), equal, "left_semi"))
    whole = repeats.select(
        ROW, (side - F.shiftright("place", 8).bitwiseAND(F.lit(255))).alias("a"), (side + F.col("place").bitwiseAND(F.lit(255))).alias("b")
    )
    mixed = written(groups.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1").select(F.col("gram").alias("g"), "contexts"), "mixed")
    blocks = max(1, -(-(mixed.agg(F.sum("contexts")).first()[0] or 0) // (BLOCK // 4)))
    block = F.when(F.col("contexts") <= BLOCK, F.pmod(F.xxhash64("gram"), F.lit(blocks)).cast("int"))
    asked = groups.join(mixed, groups["gram"] == mixed["g"]).select(F.col(f"at.{ROW}").alias("r"), F.struct(block.alias("block"), "gram", (F.col("n") > 1).alias("many"), "at.place").alias("x"))
    lists = asked.groupBy("r").agg(F.collect_list("x").alias("asked"))
    contexts = written(
        texts.join(lists, texts[ROW] == lists["r"]).select(ROW, "text", "asked").mapInArrow(_contexts, f"block int, gram long, many boolean, {ROW} long, place long, bytes binary"), "context-bytes"
    )
    sorted_blocks = contexts.filter("block is not null").groupBy("block").applyInArrow(_sorted_block, f"{ROW} long, a long, b long")
    windows = written(contexts.filter("block is null").mapInArrow(_windows, f"gram long, many boolean, {ROW} long, place long, column int, hash long"), "windows")
    shared = windows.groupBy("gram", "column", "hash").agg(F.sum(F.col("many").cast("int") + 1).alias("n")).filter("n > 1").select(F.col("gram").alias("g"), F.col("column").alias("c"), F.col("hash").alias("h"))
    begin = side - REACH + F.col("column")
    counted = windows.filter("not many").join(shared, (F.col("gram") == F.col("g")) & (F.col("column") == F.col("c")) & (F.col("hash") == F.col("h")), "left_semi").select(ROW, begin.alias("a"), (begin + LENGTH).alias("b"))
    return whole.unionByName(sorted_blocks).unionByName(counted)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    doc = F.col("doc")
    texts = numbered(docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))).select(ROW, doc["doc_id"].alias("doc_id"), doc["text"].alias("text"))
    ranges = covered(texts.select(ROW, "text")).groupBy(F.col(ROW).alias("r")).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.join(ranges, texts[ROW] == ranges["r"], "left").select("doc_id", "text", "ranges").mapInArrow(_cut, f"doc_id {kind}, {REMOVED}")


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


QUERIES = {"op2_suffixes": op2_suffixes}
#: By brute force over hex digits: every window's digest is counted.
SQL = {
    "op2_suffixes": r"""
    with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    parts as (select r, s, substring(h, 2 * s + 1, 1398) as part from (select r, h, unnest(range(0, len(h) // 2 - 199, 500)) as s from d)),
    w as (select r, s + i as p, md5_number(substring(part, 2 * i + 1, 400)) as string from (select r, s, part, unnest(range(len(part) // 2 - 199)) as i from parts)),
    again as (select string from w group by string having count(*) > 1),
    marked as (select r, p, case when p <= lag(p) over (partition by r order by p) + 200 then 0 else 1 end as fresh from w where string in (select string from again)),
    spans as (select r, n, min(p) as a, max(p) + 200 as b from (select r, p, sum(fresh) over (partition by r order by p) as n from marked) group by r, n),
    pieces as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as c from spans),
    cut as (select r, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last, string_agg(substring(h, 2 * c + 1, 2 * (a - c)), '' order by a) as head from pieces join d using (r) group by r)
    select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
           sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
    from d left join cut using (r)
    """
}
