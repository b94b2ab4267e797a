"""Operator 5: near-duplicate classes by ProbMinHash signatures, banding and exact verification.

Each text is a set of shingles of five words. Every shingle is a Poisson process whose points fall on
the signature's components without replacement; a component keeps its first point, and a shingle's
points stop once they come later than all the components hold. The share of equal components estimates
the probability Jaccard similarity, which is that of the plain sets, as all shingles weigh 1 however
often they occur: bands, prefilter and verification go by one measure.

Texts that agree in a band of components are candidates. Links are verified on the shingle sets
themselves: Jaccard similarity of at least the threshold. A bucket's rows are first verified against
one centre, the row that shares most buckets with others: in a group of copies that is the text nearest
to their original, so the buckets of a group elect the same centre. Rows in another component are then
verified against a second centre of theirs, and against up to CENTRES in all while more than a block of
them is left. In buckets that still hold several components the rows outside the main one are compared
with all, in blocks of BLOCK rows or BLOCK_BYTES inside the tasks, which give back only links that join
components. No bucket is capped.

Defined results: a null text counts as empty; texts without words are classes of their own; texts with
the same words in the same order share a class without pairing; the class id is the least id in it, a
null id comes last; of a class the row with the least id (then first in the scan) stays. An empty
table gives an empty result. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from . import textnum as tn
from .common import ROW, column, documents, numbered, without, written

WORDS, THRESHOLD = 5, 0.8
#: A prime number of components, 26 bands of 5: a pair at similarity 0.8 shares no band with probability 3e-5.
SIZE, BANDS, BAND_ROWS = 131, 26, 5
#: Candidates whose signatures agree less than this aren't verified: 5 standard deviations below 0.8.
LEAST_ESTIMATE = 0.62
#: Rows of a bucket that a task compares with each other at a time, and bytes of their shingle sets.
BLOCK, BLOCK_BYTES = 1000, 64 << 20
#: Rounds of centres, at most, before what is left of a bucket is compared in blocks.
CENTRES = 6

_U = np.uint64


def signatures(shingle: np.ndarray, text: np.ndarray, weight: np.ndarray, texts: int, size: int = SIZE) -> np.ndarray:
    """ProbMinHash signatures (texts x size) of weighted sets; 0 where a text has no shingle. size is prime."""
    first = np.full(texts * size, np.inf)
    out = np.zeros(texts * size, dtype=np.uint64)
    stop = np.full(texts, np.inf)
    mixed = tn.mix(shingle + _U(0x1234567))
    place = (mixed % _U(size)).astype(np.int64)
    step = 1 + ((mixed >> _U(32)) % _U(size - 1)).astype(np.int64)
    element, owner, rate, time = shingle, text, weight, np.zeros(len(shingle))
    for i in range(size):
        uniform = (tn.mix(element + _U((i + 1) * 0xD1342543DE82EF95 % 2**64)) >> _U(11)).astype(np.float64) * 2.0**-53
        time = time - np.log1p(-uniform) * (size / (size - i)) / rate
        on = time < stop[owner]
        if not on.any():
            break
        element, owner, rate, time, place, step = (x[on] for x in (element, owner, rate, time, place, step))
        at = owner * size + place
        np.minimum.at(first, at, time)
        won = time == first[at]
        out[at[won]] = element[won]
        active = np.unique(owner)
        stop[active] = first.reshape(texts, size)[active].max(axis=1)
        place = (place + step) % size
    return out.reshape(texts, size)


SIGNED = "__row long, doc_id {id}, key binary, shingles long, bands array<long>, brief binary"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = tn.as_text(batch.column("text"))
        for a, b in tn.slices(column):
            part = column.slice(a, b - a)
            word, bounds = tn.words(part)
            n = b - a
            value, text, _ = tn.distinct_in_text(*tn.shingles(word, bounds, WORDS))
            sig = signatures(value, text, np.ones(len(value)), n)
            band = np.zeros((n, BANDS), dtype=np.uint64)
            for j in range(BAND_ROWS):
                band = tn.mix(band * _U(0x9E3779B97F4A7C15) + sig[:, j * BANDS : (j + 1) * BANDS] + np.arange(BANDS, dtype=np.uint64))
            # Two hashes of the word sequence: texts that share both are one text to this operator.
            place = (np.arange(len(word)) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.uint64)
            keys = [_sums(tn.mix(word ^ tn.mix(place + _U(s))), bounds) for s in (17, 71)]
            full = np.diff(bounds) > 0
            key = np.stack([*keys, np.diff(bounds).astype(np.uint64)], axis=1)
            brief = (sig[:, : BANDS * BAND_ROWS] & _U(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(ROW).slice(a, n),
                    batch.column("doc_id").slice(a, n),
                    pa.array([k.tobytes() if ok else None for k, ok in zip(key, full, strict=True)], pa.binary()),
                    pa.array(np.bincount(text, minlength=n).astype(np.int64)),
                    pa.array([list(x) if ok else [] for x, ok in zip(band.view(np.int64), full, strict=True)], pa.list_(pa.int64())),
                    pa.array([x.tobytes() for x in brief], pa.binary()),
                ],
                names=[ROW, "doc_id", "key", "shingles", "bands", "brief"],
            )


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return running[bounds[1:]] - running[bounds[:-1]]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's sorted shingle set as bytes."""
    for batch in batches:
        column = tn.as_text(batch.column("text"))
        for a, b in tn.slices(column):
            value, text, _ = tn.distinct_in_text(*tn.shingles(*tn.words(column.slice(a, b - a)), WORDS))
            at = np.searchsorted(text, np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays([batch.column(ROW).slice(a, b - a), pa.array([value[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.large_binary())], names=["node", "shingles"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
            keep.append(both + 1e-9 >= THRESHOLD * (len(p) + len(q) - both) and len(p) > 0)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures agree enough to be worth a look at their sets."""
    width = BANDS * BAND_ROWS
    for batch in batches:
        p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, width) for c in ("x", "y"))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array((p == q).mean(axis=1) >= LEAST_ESTIMATE))


def _links(pairs: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that are links."""
    brief = signed.select(F.col(ROW).alias("node"), "brief")
    near = written(
        pairs.join(brief.select(F.col("node").alias("u"), F.col("brief").alias("x")), "u")
        .join(brief.select(F.col("node").alias("v"), F.col("brief").alias("y")), "v")
        .select("u", "v", "x", "y")
        .mapInArrow(_similar, "u long, v long"),
        "near",
    )
    nodes = near.select(F.col("u").alias("node")).unionByName(near.select(F.col("v").alias("node"))).distinct()
    sets = written(texts.join(nodes, texts[ROW] == nodes["node"], "left_semi").select(ROW, "text").mapInArrow(_sets, "node long, shingles binary"), "sets")
    both = near.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(_verified, "u long, v long")


def _joined(table: pa.Table) -> pa.Table:
    """Links between components among the rows of a block or of two: a forest, so fewer than the rows."""
    node, root, side = (table.column(c).to_numpy() for c in ("node", "root", "side"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
    size = np.array([len(x) for x in sets], dtype=np.float32)
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    shared = np.cumsum(count > 1) - 1
    column, owner = shared[column][(count > 1)[column]], owner[(count > 1)[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, [first, first + 2048])
        part = np.zeros((len(sets), 2048), dtype=np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        both += part @ part.T
    two = side.max() > side.min()
    near = (both.astype(float) + 1e-9 >= THRESHOLD * (size[:, None].astype(float) + size[None, :] - both)) & (root[:, None] != root[None, :])
    near &= (side[:, None] < side[None, :]) if two else np.triu(np.ones_like(near), 1)
    lead: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := lead.get(x, x)) != x:
            lead[x] = lead.get(up, up)
            x = up
        return x

    out: list[tuple[int, int]] = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
        p, q = find(int(root[i])), find(int(root[j]))
        if p != q:
            lead[max(p, q)] = min(p, q)
            out.append((int(node[i]), int(node[j])))
    return pa.table({"u": pa.array([min(x) for x in out], pa.int64()), "v": pa.array([max(x) for x in out], pa.int64())})


BUCKET = ["band", "hash"]


def _centres(member: DataFrame) -> DataFrame:
    """The row of each bucket that shares most buckets with others."""
    top = F.max(F.struct("popular", "node", "root")).alias("c")
    return written(member.groupBy(*BUCKET).agg(top).select(*BUCKET, F.col("c.node").alias("c_node"), F.col("c.root").alias("c_root")), "centres")


def _pairs(member: DataFrame, centres: DataFrame) -> DataFrame:
    return member.join(centres, BUCKET).filter("root <> c_root").select(F.least("node", "c_node").alias("u"), F.greatest("node", "c_node").alias("v")).distinct()


def _placed(sized: DataFrame) -> DataFrame:
    """Rows of buckets in the pairs of blocks (low, high) in which they are compared; side is a row's own block.

    sized: band, hash, node, root, inner (whether the row is in the main component), bytes. Rows outside the main
    component meet all rows of their bucket; those inside, already one component, don't meet each other.
    """
    def blocks(which: Column) -> Column:
        rows, held = F.count_if(which), F.sum(F.when(which, F.col("bytes")).otherwise(0))
        return F.ceil(F.greatest(rows / BLOCK, held / BLOCK_BYTES)).cast("int")

    whole = blocks(F.lit(True)) <= 1
    counts = sized.groupBy(*BUCKET).agg(
        F.when(whole, 1).otherwise(blocks(~F.col("inner"))).alias("outside"), F.when(whole, 0).otherwise(blocks(F.col("inner"))).alias("inside")
    )
    hashed = F.xxhash64("node")
    away = F.col("inner") & (F.col("inside") > 0)
    block = F.when(away, F.col("outside") + F.pmod(hashed, F.col("inside"))).otherwise(F.pmod(hashed, F.col("outside"))).cast("int")
    met = F.when(away, F.col("outside")).otherwise(F.col("outside") + F.col("inside")) - 1
    placed = sized.join(counts, BUCKET).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), met)))
    return placed.select(*BUCKET, "node", "root", F.col("block").alias("side"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def bucket_links(rows: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (u, v) of which the components are those of all links. rows: band, hash, node, popular."""
    single = rows.withColumn("root", F.col("node"))
    links = written(_links(_pairs(single, _centres(single)), signed, texts), "links")

    def rooted() -> DataFrame:
        """Rows of buckets that hold several roots. Equal roots are connected; two steps find all of a star."""
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")).select(F.col("u").alias("v"), "low")
        roots = both.join(first, "v").groupBy("u").agg(F.least(F.min("low"), F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "node")
        member = rows.join(written(roots, "roots"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        # Most rows of a bucket lie in the component of its most shared row; main is that component.
        main = F.max(F.struct("popular", "node", "root")).alias("c")
        split = member.groupBy(*BUCKET).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), main)
        split = split.filter("low < high and n > 2").select(*BUCKET, F.col("c.root").alias("main"))
        return written(member.join(split, BUCKET), "member")

    member = rooted()
    for turn in range(1, CENTRES):
        others = member.filter("root <> main")
        most = others.groupBy(*BUCKET).count().agg(F.max("count").alias("n")).first()["n"] or 0
        if not most or (turn > 1 and most <= BLOCK):
            break
        links = links.unionByName(written(_links(_pairs(others, _centres(others)), signed, texts), "links"))
        member = rooted()
    if not member.isEmpty():
        size = signed.select(F.col(ROW).alias("node"), (F.col("shingles") * 8).alias("bytes"))
        sized = written(member.select(*BUCKET, "node", "root", (F.col("root") == F.col("main")).alias("inner")).join(size, "node"), "sized")
        placed = _placed(sized)
        asked = member.select(F.col("node").alias("n")).distinct()
        sets = written(texts.join(asked, texts[ROW] == asked["n"], "left_semi").select(ROW, "text").mapInArrow(_sets, "node long, shingles binary"), "sets")
        links = links.unionByName(written(placed.join(sets, "node").groupBy(*BUCKET, "low", "high").applyInArrow(_joined, "u long, v long"), "links"))
    return links


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: __row (its number), doc_id, class_id, class_size, kept."""
    return _classes(numbered(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))), "doc_id", "text")


def _classes(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Classes of numbered rows."""
    doc = F.col("doc")
    texts = rows.select(ROW, doc[id_col].alias("doc_id"), doc[text_col].cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    signed = written(texts.mapInArrow(_signed, SIGNED.format(id=kind)), "signed")
    # One node for each word sequence: the first row that has it. Partly aggregated before the shuffle.
    keyed = signed.filter("key is not null")
    nodes = written(keyed.groupBy("key").agg(F.min(ROW).alias("node")), "nodes")
    heads = nodes.select(F.col("node").alias(ROW))
    banded = written(keyed.join(heads, ROW, "left_semi").select(F.col(ROW).alias("node"), F.posexplode("bands").alias("band", "hash")), "bands")
    held = banded.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(banded.join(held, BUCKET), "shared")
    rows = written(shared.drop("n").join(shared.groupBy("node").agg(F.sum("n").alias("popular")), "node"), "buckets")
    links = bucket_links(rows, signed, texts)
    roots = components(links)
    rooted = keyed.join(nodes, "key").join(roots, "node", "left").select(ROW, F.coalesce("root", "node").alias("root"))
    placed = signed.select(ROW, "doc_id").join(rooted, ROW, "left").withColumn("root", F.coalesce("root", ROW))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    classes = written(placed.groupBy("root").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("class_size")), "classes")
    return placed.join(classes, "root").select(ROW, "doc_id", F.col("first.id").alias("class_id"), "class_size", (F.col(ROW) == F.col("first.row")).alias("kept"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with the columns of docs."""
    rows = numbered(docs)
    return without(rows, _classes(rows, id_col, text_col).filter("not kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir)).drop(ROW)


QUERIES = {"op5_near_dedup": op5_near_dedup}
SQL: dict[str, str] = {}
