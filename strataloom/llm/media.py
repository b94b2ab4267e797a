"""Operator 1: media columns in archives, by a custom Spark data source.

Format "media_archive": a folder of ZIP archives whose members are media files, and a manifest for each
write that was committed. Each write task rolls over archives of its own; only archives of committed
tasks are in a manifest, so a lost executor or a second attempt leaves no double members, and the commit
removes what such attempts left. Appending adds a manifest; overwriting removes all earlier ones and
their archives once its own stands. Reading plans byte ranges over the archives of all manifests; a task
takes the members whose header begins in its range from the archive's directory, reads each at its
offset, holds it against the directory's checksum, and retries that member alone. Members stream out in
Arrow batches of bounded size.

A text is stored as an 8-bit grey PNG, 64 samples wide: its UTF-8 bytes, padded with 0 to a positive
multiple of 64. The unpadded length is a text chunk of the image.

Defined results: a null text counts as empty (64 samples of 0); a null key stays null; repeated rows
are members of their own; an empty table gives an empty archive folder and no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import column, documents, shared_dir

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MANIFEST = "manifest-"
#: Bytes of an archive before a task begins the next, of a read range, and of an Arrow batch.
ARCHIVE, RANGE, BATCH = 128 << 20, 64 << 20, 8 << 20
#: Attempts at a member, and the pause after the first failure, which doubles.
ATTEMPTS, PAUSE = 3, 0.1


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(raw: bytes) -> bytes:
    """The bytes as grey samples, WIDTH a row."""
    rows = max(1, -(-len(raw) // WIDTH))
    samples = np.zeros((rows, WIDTH + 1), dtype=np.uint8)  # each row begins with filter 0
    samples[:, 1:] = np.frombuffer(raw.ljust(rows * WIDTH, b"\0"), dtype=np.uint8).reshape(rows, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"tEXt", b"Bytes\0" + str(len(raw)).encode()) + _chunk(b"IDAT", zlib.compress(samples.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> tuple[np.ndarray, int]:
    """The samples, a row each, and the unpadded length. Whatever is wrong with the image is a ValueError."""
    try:
        return _samples(image)
    except (struct.error, zlib.error) as e:
        raise ValueError(f"a damaged image: {e}") from e


def _samples(image: bytes) -> tuple[np.ndarray, int]:
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, length, size = 8, [], None, (0, 0)
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, rows, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("not plain 8-bit grey")
            size = (rows, width)
        elif kind == b"tEXt" and body.startswith(b"Bytes\0"):
            length = int(body[6:])
        elif kind == b"IDAT":
            packed.append(body)
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(size[0], size[1] + 1)
    if rows[:, 0].any():
        raise ValueError("rows with a filter aren't supported")
    return rows[:, 1:], size[0] * size[1] if length is None else length


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation and an 8 x 8 mean hash of an image."""
    rows = len(samples)
    total, squares = int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum())
    n = samples.size
    edges = (np.arange(8) * rows) // 8
    bands = np.add.reduceat(samples.sum(axis=0, dtype=np.int64)[None] if rows < 8 else samples.astype(np.int64), np.minimum(edges, rows - 1) if rows >= 8 else [0], axis=0)
    cells = np.add.reduceat(bands, np.arange(0, samples.shape[1], max(1, samples.shape[1] // 8)), axis=1).astype(float)
    means = cells / np.maximum(np.diff(np.append(edges, rows)), 1)[:, None] if rows >= 8 else cells / rows
    bits = "".join("1" if x else "0" for x in (means > means.mean()).ravel())
    return f"{samples.shape[1]}x{rows};mean={total / n:.4f};std={max(squares / n - (total / n) ** 2, 0) ** 0.5:.4f};hash={int(bits, 2):0{-(-len(bits) // 4)}x}"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int


class MediaArchive(DataSource):
    """Options: path, and onError ("fail", or "row" for a row with the error instead of the media)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "key string, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options, overwrite)


class ArchiveWriter(DataSourceArrowWriter):
    """Writes rows of (key string, media binary)."""

    def __init__(self, options, overwrite: bool = False):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        filesystem, folder = _filesystem(self.path)
        filesystem.create_dir(folder, recursive=True)
        done: list[tuple[str, int]] = []
        stream = archive = None
        members = 0
        for batch in batches:
            for key, media in zip(batch.column("key"), batch.column("media"), strict=True):
                if archive is None:
                    name = f"{self.job}-{uuid.uuid4().hex}.zip"
                    stream = filesystem.open_output_stream(f"{folder}/{name}")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
                label = "" if not key.is_valid else "/" + quote(key.as_py(), safe="")
                archive.writestr(zipfile.ZipInfo(f"{members:x}{label}"), media.as_py())
                members += 1
                if stream.tell() >= ARCHIVE:
                    done.append(self._closed(archive, stream, name))
                    archive = None
        if archive is not None:
            done.append(self._closed(archive, stream, name))
        return Written(done)

    @staticmethod
    def _closed(archive, stream, name: str) -> tuple[str, int]:
        archive.close()
        size = stream.tell()
        stream.close()
        return name, size

    def commit(self, messages) -> None:
        filesystem, folder = _filesystem(self.path)
        filesystem.create_dir(folder, recursive=True)
        archives = [a for m in messages if m is not None for a in m.archives]
        earlier = _manifests(filesystem, folder) if self.overwrite else []
        replaced = [name for manifest in earlier for name, _ in _archives(filesystem, f"{folder}/{manifest}")]
        with filesystem.open_output_stream(f"{folder}/{MANIFEST}{self.job}.json") as out:
            out.write(json.dumps(archives).encode())
        committed = {name for name, _ in archives}
        left = [name for name in _files(filesystem, folder) if name.startswith(f"{self.job}-") and name not in committed]
        for name in [*earlier, *replaced, *left]:
            filesystem.delete_file(f"{folder}/{name}")

    def abort(self, messages) -> None:
        filesystem, folder = _filesystem(self.path)
        for name in _files(filesystem, folder):
            if name.startswith(f"{self.job}-"):
                filesystem.delete_file(f"{folder}/{name}")


def _files(filesystem, folder: str) -> list[str]:
    from pyarrow import fs

    return sorted(f.base_name for f in filesystem.get_file_info(fs.FileSelector(folder, allow_not_found=True)))


def _manifests(filesystem, folder: str) -> list[str]:
    return [name for name in _files(filesystem, folder) if name.startswith(MANIFEST)]


def _archives(filesystem, manifest: str) -> list[tuple[str, int]]:
    """Name and size of each archive that a manifest lists."""
    with filesystem.open_input_file(manifest) as f:
        return [(name, size) for name, size in json.loads(f.read())]


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.fail = options.get("onError", "fail") == "fail"

    def partitions(self) -> list[InputPartition]:
        filesystem, folder = _filesystem(self.path)
        archives = [a for manifest in _manifests(filesystem, folder) for a in _archives(filesystem, f"{folder}/{manifest}")]
        ranges = [Range(name, start, min(start + RANGE, size)) for name, size in archives for start in range(0, size, RANGE)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        filesystem, folder = _filesystem(self.path)
        source = _Members(filesystem, f"{folder}/{partition.archive}")
        keys, media, errors, held = [], [], [], 0
        for info in source.between(partition.start, partition.end):
            _, slash, key = info.filename.partition("/")
            keys.append(unquote(key) if slash else None)
            try:
                media.append(source.read(info))
                errors.append(None)
            except (OSError, ValueError) as e:
                if self.fail:
                    raise
                media.append(None)
                errors.append(str(e))
            held += info.file_size
            if held >= BATCH:
                yield self._batch(keys, media, errors)
                keys, media, errors, held = [], [], [], 0
        if keys:
            yield self._batch(keys, media, errors)

    @staticmethod
    def _batch(keys: list, media: list, errors: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(media, pa.binary()), pa.array(errors, pa.string())], names=["key", "media", "error"])


class _Members:
    """An archive's members, each read at its offset and retried alone."""

    def __init__(self, filesystem, path: str):
        self.filesystem, self.path = filesystem, path
        self.file = filesystem.open_input_file(path)

    def between(self, start: int, end: int) -> list[zipfile.ZipInfo]:
        with zipfile.ZipFile(self.file) as archive:
            found = [i for i in archive.infolist() if start <= i.header_offset < end]
        self.file = self.filesystem.open_input_file(self.path)
        return sorted(found, key=lambda i: i.header_offset)

    def read(self, info: zipfile.ZipInfo) -> bytes:
        for attempt in range(ATTEMPTS):
            try:
                self.file.seek(info.header_offset)
                head = self.file.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError(f"no member at {info.header_offset} of {self.path}")
                name, extra = struct.unpack_from("<HH", head, 26)
                self.file.seek(info.header_offset + 30 + name + extra)
                body = self.file.read(info.compress_size)
                if len(body) != info.compress_size or zlib.crc32(body) != info.CRC:
                    raise ValueError(f"the member at {info.header_offset} of {self.path} is damaged")
                return body
            except (OSError, ValueError):
                if attempt + 1 == ATTEMPTS:
                    raise
                time.sleep(PAUSE * 2**attempt)
                self.file = self.filesystem.open_input_file(self.path)
        raise AssertionError


def _pictured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and images of the texts, about BATCH bytes of images at a time."""
    for batch in batches:
        images, start, held = [], 0, 0
        for i in range(batch.num_rows):
            images.append(to_png((batch.column("text")[i].as_py() or "").encode()))
            held += len(images[-1])
            if held >= BATCH or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(start, i + 1 - start), pa.array(images, pa.binary())], names=["key", "media"])
                images, start, held = [], i + 1, 0


READ = "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in batch.column("media"):
            image = media.as_py()
            if image is None:  # a member that couldn't be read
                rows.append((None,) * 7)
                continue
            samples, length = from_png(image)
            payload = samples.tobytes()
            rows.append((length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=[x.split()[0] for x in READ.split(", ")])


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "append") -> None:
    """Write every text as a member of the archives in path, beside those there or (mode overwrite) instead of them."""
    docs.sparkSession.dataSource.register(MediaArchive)
    texts = docs.select(column(id_col).cast("string").alias("key"), column(text_col).cast("string").alias("text"))
    texts.mapInArrow(_pictured, "key string, media binary").write.format("media_archive").mode(mode).save(path)


def load(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """The archives' members: key, media, error."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("onError", on_error).load(path)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    store(docs, path)
    kind = docs.schema["doc_id"].dataType
    return load(spark, path).mapInArrow(_described, READ).withColumn("doc_id", F.col("key").cast(kind)).select("doc_id", *[x.split()[0] for x in READ.split(", ")[1:]])


QUERIES = {"op1_media": op1_media}
SQL: dict[str, str] = {}
