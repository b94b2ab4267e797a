"""Markdown bundles: a folder with a file for each node, its metadata as front matter, its relations and a hash.

Writing goes through a data source. Tasks write files into folders of their own under a staging folder and
report them; the commit deletes folders of attempts that weren't reported, writes an index with the number
of files, and moves the staging folder to its place, which mustn't exist: a bundle is there whole or not
at all. Reading lists and reads files in tasks and parses them by expressions; a file that doesn't match
its hash, or a bundle that isn't complete, is an error.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .shared import written

INDEX = "index.md"
#: Most files that a task writes or reads, and texts that it holds at a time.
FILES, SLICE = 20_000, 128


def rendered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One Markdown text a node: metadata, readable relations, and a hash of the two. name: its place in the bundle."""
    links = edges.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_set("dst")).alias("links"))
    listed = F.transform(F.coalesce("links", F.array().cast("array<bigint>")), lambda x: F.concat(F.lit("- requires: "), x.cast("string")))
    body = F.concat(F.lit("---\nid: "), F.col("node_id").cast("string"), F.lit("\nrole: "), "role", F.lit("\nstatus: "), "status", F.lit("\n---\n"), F.array_join(listed, "\n"))
    name = F.concat_ws("/", "role", F.col("node_id").cast("string"))
    return nodes.join(links, "node_id", "left").select(name.alias("name"), body.alias("body")).select("name", F.concat("body", F.lit("\nsha256: "), F.sha2(F.encode("body", "UTF-8"), 256)).alias("text"))


@dataclass
class Files(WriterCommitMessage):
    folder: str
    count: int


class MarkdownBundle(DataSource):
    """Options: path. Writes rows of (name string, text string); parts of a name that are separated by / are folders."""

    @classmethod
    def name(cls) -> str:
        return "markdown_bundle"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a bundle isn't written over another one")
        return BundleWriter(self.options["path"])


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        head, _, tail = self.path.rpartition("/")
        self.staging = f"{head}/.{tail}-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Files:
        filesystem, staging = _filesystem(self.staging)
        folder, made, count = uuid.uuid4().hex, set(), 0
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                *parts, last = [quote(p, safe="") for p in name.split("/")]
                inner = "/".join([staging, folder, *parts])
                if inner not in made:
                    filesystem.create_dir(inner, recursive=True)
                    made.add(inner)
                with filesystem.open_output_stream(f"{inner}/{last}.md") as out:
                    out.write(text.encode())
                count += 1
        return Files(folder, count)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        filesystem, staging = _filesystem(self.staging)
        _, target = _filesystem(self.path)
        filesystem.create_dir(staging, recursive=True)
        kept = {m.folder: m.count for m in messages if m is not None and m.count}
        for found in filesystem.get_file_info(fs.FileSelector(staging)):
            if found.base_name not in kept:
                filesystem.delete_dir(found.path)
        with filesystem.open_output_stream(f"{staging}/{INDEX}") as out:
            out.write(f"---\nfiles: {sum(kept.values())}\n---\n".encode())
        if filesystem.get_file_info(target).type != fs.FileType.NotFound:
            filesystem.delete_dir(staging)
            raise FileExistsError(f"bundle destination already exists: {self.path}")
        filesystem.move(staging, target)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        filesystem, staging = _filesystem(self.staging)
        if filesystem.get_file_info(staging).type != fs.FileType.NotFound:
            filesystem.delete_dir(staging)


def export(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    spark = nodes.sparkSession
    spark.dataSource.register(MarkdownBundle)
    texts = rendered(nodes, edges).repartition(_tasks(spark, nodes.count()), "name")
    texts.write.format("markdown_bundle").mode("append").option("path", path).save()


def _tasks(spark: SparkSession, files: int) -> int:
    """Tasks for so many files: each takes FILES at most, however few bytes they have."""
    return max(min(spark.sparkContext.defaultParallelism, files), 1, -(-files // FILES))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The bundle's files but for the index: file. The driver lists the folders at the top only."""
    from pyarrow import fs

    filesystem, root = _filesystem(path)
    top = [(f.path, f.type == fs.FileType.Directory) for f in filesystem.get_file_info(fs.FileSelector(root))]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = _filesystem(path)
        for batch in batches:
            for place, folder in zip(batch.column("place").to_pylist(), batch.column("folder").to_pylist(), strict=True):
                inside = filesystem.get_file_info(fs.FileSelector(place, recursive=True)) if folder else [filesystem.get_file_info(place)]
                yield pa.RecordBatch.from_arrays([pa.array([f.path for f in inside if f.type == fs.FileType.File and f.base_name.endswith(".md") and f.base_name != INDEX], pa.string())], names=["file"])

    return spark.createDataFrame(top, "place string, folder boolean").repartition(max(len(top), 1)).mapInArrow(walk, "file string")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a bundle: node_id, role, status, requires (comma-joined, in order).

    Files are listed and read by tasks, FILES at most in each: Spark's text reader takes every file's name
    through the driver, and 32 files a task.
    """
    filesystem, root = _filesystem(path)
    with filesystem.open_input_stream(f"{root}/{INDEX}") as index:
        told = re.search(r"\nfiles: (\d+)", index.read().decode())
    listed = written(_listed(spark, path), "listed")
    found = listed.count()
    if told is None or int(told[1]) != found:
        raise ValueError(f"the bundle's index tells of {told and told[1]} files, there are {found}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = _filesystem(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                texts = []
                for file in batch.column("file")[at : at + SLICE].to_pylist():
                    with filesystem.open_input_stream(file) as part:
                        texts.append(part.read().decode())
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])

    files = listed.repartition(_tasks(spark, found), "file").mapInArrow(read, "text string")
    parts = F.split("text", "\nsha256: ")
    checked = files.select(F.get(parts, 0).alias("body"), F.get(parts, 1).alias("sha"))
    body = F.when(F.sha2(F.encode("body", "UTF-8"), 256) == F.col("sha"), F.col("body")).otherwise(F.raise_error(F.lit("an edited bundle file")))
    field = lambda name: F.regexp_extract("body", rf"\n{name}: ([^\n]*)", 1)
    requires = F.array_join(F.regexp_extract_all("body", F.lit(r"- requires: (\d+)"), F.lit(1)), ",").alias("requires")
    return checked.select(body.alias("body")).select(field("id").cast("long").alias("node_id"), field("role").alias("role"), field("status").alias("status"), requires)
