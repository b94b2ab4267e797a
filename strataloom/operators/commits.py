"""A versioned graph in the shared folder: atomic commits, replays, snapshots, deletion with cascades.

A commit is a folder of Parquet files with the versions that it adds (tombstones included), and one small
file head-<revision>, which is created only if it isn't there. Of writers that commit on one base, one
creates the next head; the others get a Conflict and leave nothing behind that a reader sees. Readers
list the heads and read the folders that these name, so a task that dies before the head is written
changes nothing. The create is as atomic as the store's: HDFS and local files refuse an existing file.

Versions: kind (node or edge), id, revision, gone (tombstone), and the object's fields as a struct: type,
source, target, evidence (region id), text. A delta's rows have the same fields without revision.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written
from .graph import turns

FIELDS = "kind string, id string, gone boolean, type string, source string, target string, evidence string, text string"
COLUMNS = [f.split()[0] for f in FIELDS.split(", ")]


class Conflict(Exception):
    """A commit that isn't possible, and why."""


@dataclass(frozen=True)
class Ontology:
    """Node types, and for each relation the types of its ends: (relation, source type, target type)."""

    types: tuple[str, ...]
    relations: tuple[tuple[str, str, str], ...]


def content_hash(delta: DataFrame) -> str:
    """A hash of a delta's rows, whatever their order: their number and sums of two hashes of each."""
    both = [F.sum(F.xxhash64(F.lit(seed), *COLUMNS).cast("decimal(38)")) for seed in (1, 2)]
    row = delta.select(*COLUMNS).agg(F.count(F.lit(1)), *both).first()
    return hashlib.sha256("|".join(map(str, row)).encode()).hexdigest()


class VersionedGraph:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- heads

    def heads(self) -> list[dict]:
        """What the commits say, oldest first: revision, delta, hash, approval, folder. A small file for each commit."""
        root = self._at(f"{self.path}/heads")
        if not self._fs.exists(root):
            return []
        found = []
        for status in self._fs.listStatus(root):
            stream = self._fs.open(status.getPath())
            try:
                found.append(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
        return sorted(found, key=lambda h: h["revision"])

    def revision(self) -> int:
        return max((h["revision"] for h in self.heads()), default=0)

    def _swap(self, head: dict) -> None:
        """Creates the next head, or fails if another writer was first."""
        path = self._at(f"{self.path}/heads/head-{head['revision']:012d}")
        try:
            stream = self._fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                raise Conflict("stale revision: another commit came first") from None
            raise
        try:
            stream.write(json.dumps(head).encode())
        finally:
            stream.close()

    # -- reading

    def versions(self, at: int | None = None) -> DataFrame:
        folders = [(h["folder"], h["revision"]) for h in self.heads() if at is None or h["revision"] <= at]
        if not folders:
            return self.spark.createDataFrame([], FIELDS + ", revision long")
        return self.spark.read.schema(FIELDS + ", revision long").parquet(*[f for f, _ in folders])

    def snapshot(self, at: int | None = None) -> DataFrame:
        """Live objects at a revision: the newest version of each that isn't a tombstone."""
        return _newest(self.versions(at)).filter("not gone").select(*COLUMNS)

    # -- checking and committing

    def prospective(self, delta: DataFrame) -> DataFrame:
        """The graph as it would be."""
        return self.snapshot().join(delta.select("kind", "id").distinct(), ["kind", "id"], "left_anti").unionByName(delta.filter("not gone").select(*COLUMNS))

    def issues(self, delta: DataFrame, ontology: Ontology, regions: DataFrame) -> DataFrame:
        """code, kind, id of everything that keeps a delta from being committed. regions: region_id."""
        now = written(self.prospective(delta), "prospective")
        node, edge = now.filter("kind = 'node'"), now.filter("kind = 'edge'")
        types = node.select(F.col("id").alias("end"), F.col("type").alias("end_type"))

        def ended(side: str) -> DataFrame:
            return edge.join(types.withColumnsRenamed({"end": side, "end_type": f"{side}_type"}), side, "left")

        both = ended("source").join(types.withColumnsRenamed({"end": "target", "end_type": "target_type"}), "target", "left")
        allowed: Column = F.lit(False)
        for relation, a, b in ontology.relations:
            allowed = allowed | ((F.lower("type") == relation.lower()) & (F.lower("source_type") == a.lower()) & (F.lower("target_type") == b.lower()))
        known = F.lower("type").isin([t.lower() for t in ontology.types])
        found = [
            _issue("repeated object", delta.groupBy("kind", "id").count().filter("count > 1")),
            _issue("removal of an absent object", delta.filter("gone").join(self.snapshot().select("kind", "id"), ["kind", "id"], "left_anti")),
            _issue("node type outside the ontology", node.filter(~F.coalesce(known, F.lit(False)))),
            _issue("dangling edge", both.filter("source_type is null or target_type is null")),
            _issue("edge outside the ontology", both.filter("source_type is not null and target_type is not null").filter(~F.coalesce(allowed, F.lit(False)))),
            _issue("unknown evidence", delta.filter("not gone and evidence is not null").join(regions.select(F.col("region_id").cast("string").alias("evidence")), "evidence", "left_anti")),
            _issue("node without evidence", delta.filter("not gone and kind = 'node' and evidence is null")),
        ]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    def prepare(self, name: str, delta: DataFrame, base: int, approval: str, ontology: Ontology, regions: DataFrame) -> tuple[str, DataFrame | None]:
        """What a commit would come to: committed (a replay), ready, or the reason against it; and the issues, if it came to looking for them."""
        digest = content_hash(delta)
        for head in self.heads():
            if head["delta"] == name:
                return ("committed", None) if (head["hash"], head["approval"]) == (digest, approval) else ("divergent replay", None)
        if approval != digest:
            return "approval is for another delta", None
        if base != self.revision():
            return "stale revision", None
        found = written(self.issues(delta, ontology, regions), "issues")
        return ("ready" if found.isEmpty() else "issues"), found

    def commit(self, name: str, delta: DataFrame, base: int, approval: str, ontology: Ontology, regions: DataFrame) -> int:
        """The revision that holds the delta. A replay of what is committed changes nothing and returns its revision."""
        state, found = self.prepare(name, delta, base, approval, ontology, regions)
        if state == "committed":
            return next(h["revision"] for h in self.heads() if h["delta"] == name)
        if state != "ready":
            raise Conflict(state if found is None else f"{state}: {sorted({r['code'] for r in found.select('code').distinct().collect()})}")
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        delta.select(*COLUMNS, F.lit(base + 1).cast("long").alias("revision")).write.parquet(folder)
        self._swap({"revision": base + 1, "delta": name, "hash": approval, "approval": approval, "folder": folder})
        return base + 1

    # -- deletion

    def deletion(self, gone: DataFrame, cascade: bool) -> tuple[DataFrame, DataFrame]:
        """Tombstones (FIELDS) for the objects (kind, id) and what can't be without them, and the blockers: kind, id, by.

        An edge goes with either end, a node with the node that it names as its source (a part of it). Without
        cascade, objects that refer to something that goes and stay themselves block the deletion.
        """
        now = written(self.snapshot(), "snapshot")
        refers = now.select("kind", "id", F.explode(F.array("source", "target")).alias("of")).filter("of is not null")
        seen = new = written(gone.select("kind", "id").distinct().join(now.select("kind", "id"), ["kind", "id"], "left_semi"), "gone")
        for _ in turns(None):
            hit = refers.join(new.filter("kind = 'node'").select(F.col("id").alias("of")), "of").join(seen, ["kind", "id"], "left_anti")
            if not cascade:
                tombs = now.join(seen, ["kind", "id"], "left_semi").withColumn("gone", F.lit(True)).select(*COLUMNS)
                return tombs, hit.select("kind", "id", F.col("of").alias("by")).distinct()
            new = written(hit.select("kind", "id").distinct(), "gone")
            if new.isEmpty():
                break
            seen = written(seen.unionByName(new), "gone")
        tombs = now.join(seen, ["kind", "id"], "left_semi").withColumn("gone", F.lit(True)).select(*COLUMNS)
        return tombs, self.spark.createDataFrame([], "kind string, id string, by string")


def _newest(versions: DataFrame) -> DataFrame:
    """Each object's newest version; the fields travel in a struct, so a partial aggregate runs before the shuffle."""
    fields = F.struct("revision", *[c for c in COLUMNS if c not in ("kind", "id")])
    return versions.groupBy("kind", "id").agg(F.max(fields).alias("v")).select("kind", "id", "v.*")


def _issue(code: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), "kind", "id").distinct()
