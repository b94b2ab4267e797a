"""Operator 12: near-duplicate vectors by a pivot-permutation index.

Up to PIVOTS reference points are chosen among a bounded sample of the vectors (the SAMPLE with the least
hash), no two of them alike. A vector is described by its NEAREST reference points in order of cosine:
near vectors have nearly the same order, so they share at least SHARED of these points. Reference points
are ranked by how many vectors they describe, rarest first. Any two vectors that share SHARED points
share TOGETHER of the NEAREST - SHARED + TOGETHER rarest ones, so inverted lists are kept for each
combination of TOGETHER points among those. Vectors of a list are compared by the bits of their points:
a pair with SHARED points in common counts in the list of its rarest common points only, and its cosine
is then worked out in double precision. Which pairs are candidates depends on nothing but the vectors and
the reference points, so recall is a matter of those parameters; links that are found are exact.

Vectors with the same components are one node with a count. A list of more than BLOCK nodes is dealt into
blocks that meet two by two in tasks, so no task holds more than two blocks of a list. Tasks give back the
number of links of each node and the least node it is joined to, never pairs.

Defined results: a vector that is null, zero or has a null or non-finite component, or a null label, links
with nothing; vectors of different lengths don't link. component_id leaves out null ids where others are;
rows that repeat the least id of their component are all kept. An empty table gives an empty result.
Only id, vector and label are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..operators.graph import components
from .common import column, written

COSINE = 0.98
#: At most 128, as a description is held as 128 bits.
PIVOTS, NEAREST, SHARED, TOGETHER = 128, 8, 3, 2
#: Vectors among which reference points are chosen; first they may be this alike, then more and more.
SAMPLE, ALIKE = 2048, (0.7, 0.9, 0.97, 2.0)
#: Nodes of a list that a task compares with each other at a time; smaller lists are compared many at once.
BLOCK, SMALL, PAIRS = 1024, 64, 1 << 18

CELL = ["label", "size", "list", "low", "high"]


def _unit(rows: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that no square overflows or vanishes."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _by_size(raw: list[bytes], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of one length at a time: which they are, and unit vectors."""
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        yield which, _unit(np.frombuffer(b"".join([raw[i] for i in which]), dtype=kind).reshape(len(which), -1))


def _read(kind: str):
    """Tasks' reading of vectors: null where a vector links with nothing, else its bytes and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, digest = [], []
            for value in batch.column("vector"):
                v = np.array(value.values.to_numpy(zero_copy_only=False) if value.is_valid else [], dtype=kind)
                good = len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
                raw.append((v + 0).tobytes() if good else None)  # + 0 makes one zero of both
                digest.append(hashlib.blake2b(raw[-1], digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(raw, pa.binary()), pa.array(digest, pa.binary())], names=["id", "label", "vector", "digest"])

    return run


def pivots(nodes: DataFrame, kind: str, most: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors to describe others by, of the length of the longest; shorter ones are filled with zeros."""
    raw = [bytes(r.vector) for r in nodes.orderBy(F.xxhash64("vector"), "vector").limit(sample).select("vector").collect()]
    if not raw:
        return np.zeros((0, 1))
    out = np.zeros((len(raw), max(len(x) for x in raw) // np.dtype(kind).itemsize))
    for which, unit in _by_size(raw, kind):
        out[which, : unit.shape[1]] = unit
    chosen: list[int] = []
    for alike in ALIKE:
        for i in range(len(out)):
            if len(chosen) < most and i not in chosen and (out[chosen] @ out[i] < alike).all():
                chosen.append(i)
    return out[chosen]


def _nearest(vectors: np.ndarray, points: np.ndarray, count: int) -> np.ndarray:
    width = min(vectors.shape[1], points.shape[1])
    like = vectors[:, :width] @ points[:, :width].T
    return np.argsort(-like, axis=1, kind="stable")[:, :count].astype(np.int16)


def _rows(matrix: np.ndarray) -> pa.Array:
    """A list of each row of a matrix of small numbers."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel(), pa.int16()))


def _bits(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks below 128 as two words of 64 bits."""
    one = np.uint64(1) << (ranks & 63).astype(np.uint64)
    return tuple(np.bitwise_or.reduce(np.where((ranks >> 6) == half, one, np.uint64(0)), axis=1) for half in (0, 1))


def _starts(table: pa.Table) -> np.ndarray:
    """The rows at which another list, or another pair of its blocks, begins."""
    other = np.zeros(max(0, table.num_rows - 1), dtype=bool)
    for name in CELL:
        values = table.column(name)
        other |= pc.not_equal(values.slice(1), values.slice(0, len(other))).to_numpy()
    return np.concatenate([[0], np.flatnonzero(other) + 1]).astype(np.int64)


class _Lists:
    """Rows of whole lists (or pairs of their blocks) of a task, sorted, and the links among them."""

    def __init__(self, table: pa.Table, kind: str, shared: int, together: int, cosine: float):
        self.node, self.count, self.side, self.list = (table.column(c).to_numpy() for c in ("node", "n", "side", "list"))
        # Rows of one block meet each other; where two blocks meet, only rows of different ones.
        self.alone = table.column("low").to_numpy() == table.column("high").to_numpy()
        self.low, self.high = _bits(table.column("ranks").combine_chunks().flatten().to_numpy().reshape(len(self.node), -1))
        self.starts, self.raw, self.kind = _starts(table), table.column("vector").to_pylist(), kind
        self.shared, self.together, self.cosine = shared, together, cosine

    def candidates(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs share enough points, and have this list's as the rarest of them."""
        low, high = self.low[i] & self.low[j], self.high[i] & self.high[j]
        last = self.list[i] % 128
        upto = np.uint64(1) << (last & 63).astype(np.uint64)
        upto = upto | (upto - np.uint64(1))
        first = last < 64
        rarest = np.bitwise_count(np.where(first, low & upto, low)) + np.bitwise_count(np.where(first, np.uint64(0), high & upto))
        return (np.bitwise_count(low) + np.bitwise_count(high) >= self.shared) & (rarest == self.together) & (self.alone[i] | (self.side[i] != self.side[j]))

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that are links, some at a time."""
        ends = np.append(self.starts[1:], len(self.node))
        sizes = ends - self.starts
        for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
            first = self.starts[sizes == size]
            i, j = np.triu_indices(size, 1)
            step = max(1, PAIRS // len(i))
            for a in range(0, len(first), step):
                yield self.verified((first[a : a + step, None] + i).ravel(), (first[a : a + step, None] + j).ravel())
        for a, b in zip(self.starts[sizes > SMALL].tolist(), ends[sizes > SMALL].tolist(), strict=True):
            unit = _unit(np.frombuffer(b"".join(self.raw[a:b]), dtype=self.kind).reshape(b - a, -1))
            step = max(1, PAIRS // (b - a))
            for c in range(0, b - a, step):
                i, j = np.nonzero(unit[c : c + step] @ unit.T >= self.cosine)
                i, j = i[i + c < j] + a + c, j[i + c < j] + a
                on = self.candidates(i, j)
                yield i[on], j[on]

    def verified(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs of small lists that are links."""
        on = self.candidates(i, j)
        i, j = i[on], j[on]
        rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        near = np.zeros(len(i), dtype=bool)
        a, b = at[: len(i)], at[len(i) :]
        for which, unit in _by_size([self.raw[r] for r in rows], self.kind):
            place = np.full(len(rows), -1)
            place[which] = np.arange(len(which))
            mine = np.flatnonzero(place[a] >= 0)
            for c in range(0, len(mine), 1 << 14):
                part = mine[c : c + (1 << 14)]
                near[part] = np.einsum("ij,ij->i", unit[place[a[part]]], unit[place[b[part]]]) >= self.cosine
        return i[near], j[near]

    def found(self) -> pa.RecordBatch:
        """The nodes with links here: how many vectors those join them to, and the least node they are joined to."""
        links, root = np.zeros(len(self.node), dtype=np.int64), np.arange(len(self.node))
        for i, j in self.links():
            np.add.at(links, i, self.count[j])
            np.add.at(links, j, self.count[i])
            while len(i):
                before = root.copy()
                low = np.minimum(root[i], root[j])
                for end in (i, j, before[i], before[j]):
                    np.minimum.at(root, end, low)
                root = root[root]
                if (root == before).all():
                    break
        on = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(self.node[on]), pa.array(links[on]), pa.array(self.node[root[on]])], names=["node", "links", "root"])


def _compared(kind: str, shared: int, together: int, cosine: float):
    """Tasks' comparison of sorted lists as they stream by; a list that a batch cuts waits for the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            if not table.num_rows:
                continue
            cut = int(_starts(table)[-1])
            rest = table.slice(cut)
            if cut:
                yield _Lists(table.slice(0, cut), kind, shared, together, cosine).found()
        if rest is not None and rest.num_rows:
            yield _Lists(rest, kind, shared, together, cosine).found()

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", most: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, together: int = TOGETHER) -> DataFrame:
    """A row for each vector: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    held = vectors.schema[vector_col].dataType
    single = isinstance(held, ArrayType) and isinstance(held.elementType, FloatType)
    kind, element = ("<f4", "float") if single else ("<f8", "double")
    asked = vectors.select(column(id_col).alias("id"), column(label_col).alias("label"), column(vector_col).cast(f"array<{element}>").alias("vector"))
    types = {f.name: f.dataType.simpleString() for f in asked.schema}
    rows = written(asked.mapInArrow(_read(kind), f"id {types['id']}, label {types['label']}, vector binary, digest binary"), "vectors")
    # The digest stands for the components; equal ones are one node. Partly aggregated before the shuffle.
    grouped = rows.filter("digest is not null and label is not null").groupBy("label", "digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.any_value("vector").alias("vector"))
    nodes = written(grouped.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    points = pivots(nodes, kind, most)
    nearest = min(nearest, len(points))
    shared = min(shared, nearest)
    together = min(together, shared)
    links = _linked(spark, nodes, points, kind, cosine, nearest, shared, together) if len(points) else None
    if links is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = nodes.select("node", "label", "digest", "least", "n").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(joined.select("label", "digest", "least", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(least, "root").select("label", "digest", "n_links", "component_id")
    linked = rows.select("id", "label", "digest").join(known, ["label", "digest"], "left")
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return linked.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _linked(spark: SparkSession, nodes: DataFrame, points: np.ndarray, kind: str, cosine: float, nearest: int, shared: int, together: int) -> DataFrame:
    """For each node of a list that has links there: node, links (vectors linked), root (least node joined)."""
    sent = spark.sparkContext.broadcast(points)  # at most PIVOTS vectors

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("vector").to_pylist()
            size, out = np.zeros(len(raw), dtype=np.int32), np.zeros((len(raw), nearest), dtype=np.int16)
            for which, unit in _by_size(raw, kind):
                size[which], out[which] = unit.shape[1], _nearest(unit, sent.value, nearest)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), pa.array(size), _rows(out)], names=["node", "label", "size", "points"])

    label = nodes.schema["label"].dataType.simpleString()
    signs = written(nodes.select("node", "label", "vector").mapInArrow(described, f"node long, label {label}, size int, points array<smallint>"), "points")
    # One row for each reference point. Rarest first, so that lists of common points are seldom needed.
    counted = signs.select(F.explode("points").alias("point")).groupBy("point").count().collect()
    order = {r["point"]: i for i, r in enumerate(sorted(counted, key=lambda r: (r["count"], r["point"])))}
    rank = np.array([order.get(p, len(points) - 1) for p in range(len(points))], dtype=np.int16)
    chosen = np.array(list(combinations(range(nearest - shared + together), together)), dtype=np.int64)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ranks = np.sort(rank[batch.column("points").flatten().to_numpy()].reshape(batch.num_rows, -1), axis=1)
            key = np.zeros((len(ranks), len(chosen)), dtype=np.int64)
            for j in range(together):
                key = key * 128 + ranks[:, chosen[:, j]]
            of = np.repeat(np.arange(len(ranks)), len(chosen))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(of)) for c in ("node", "label", "size")], pa.array(key.ravel())], names=["node", "label", "size", "list"])

    lists = written(signs.mapInArrow(listed, f"node long, label {label}, size int, list long"), "lists")
    counts = lists.groupBy("label", "size", "list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    side = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = lists.join(counts, ["label", "size", "list"]).withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.select("node", "label", "size", "list", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = rank[batch.column("points").flatten().to_numpy()].reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), _rows(ranks)], names=["node", "ranks"])

    payload = nodes.select("node", "n", "vector").join(signs.select("node", "points").mapInArrow(ranked, "node long, ranks array<smallint>"), "node")
    met = cells.join(payload, "node").repartition(*CELL).sortWithinPartitions(*CELL, "node")
    return written(met.mapInArrow(_compared(kind, shared, together, cosine), "node long, links long, root long"), "links")


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_embedding_dedup": op12_embedding_dedup}
#: All pairs of a label.
SQL = {
    "op12_embedding_dedup": """
    with recursive e as (select row_number() over () as r, vec_id, label, embedding::double[] as v from embeddings),
    good as (select r, vec_id, label, v from e where label is not null and v is not null and list_bool_and(list_transform(v, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(v, lambda x: x <> 0))),
    links as (select a.r as a, b.r as b from good a join good b on a.label = b.label and a.r <> b.r and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.98),
    reached as (select r as a, r as b from e union select x.a, l.b from reached x join links l on x.b = l.a),
    least as (select x.a, min(e.vec_id) as component_id from reached x join e on e.r = x.b group by x.a),
    counts as (select a, count(*) as n from links group by a)
    select e.vec_id, coalesce(c.n, 0)::bigint as n_links, l.component_id, e.vec_id is not distinct from l.component_id as kept
    from e join least l on l.a = e.r left join counts c on c.a = e.r
    """
}
