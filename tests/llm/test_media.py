"""Operator 1: exact round trips, retries, defined results."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from strataloom.llm import media


def test_png_round_trip():
    for raw in (b"", b"a", b"x" * 64, bytes(range(256)) * 3):
        samples, length = media.from_png(media.to_png(raw))
        assert length == len(raw) and samples.tobytes() == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    damaged = bytearray(media.to_png(b"hello"))
    damaged[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(damaged))


def test_texts_come_back(spark, table, hard, tmp_path):
    docs = table(hard, extra=["key", "media"])
    media.store(docs, str(tmp_path / "archives"))
    rows = media.load(spark, str(tmp_path / "archives")).mapInArrow(media._described, media.READ).collect()
    want = sorted((str(i), hashlib.sha256((t or "").encode().ljust(max(64, -(-len((t or "").encode()) // 64) * 64), b"\0")).hexdigest(), len((t or "").encode())) for i, t in hard)
    assert sorted((str(r.key), r.payload_sha256, r.n_bytes) for r in rows) == want
    empty = next(r for r in rows if r.key == "2")
    assert (empty.payload_bytes, empty.tail_crc32) == (64, zlib.crc32(b"\0" * 64))
    assert len({(r.media_sha256, r.feature) for r in rows if r.key == "4"}) == 1


def test_small_ranges_read_each_member_once(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "RANGE", 500)
    docs = table([(i, f"text {i} " * i) for i in range(50)])
    media.store(docs, str(tmp_path / "a"))
    reader = media.ArchiveReader({"path": str(tmp_path / "a")})
    keys = [k for p in reader.partitions() for b in reader.read(p) for k in b.column("key").to_pylist()]
    assert sorted(map(int, keys)) == list(range(50)) and len(reader.partitions()) > 3


def test_damaged_member_alone_fails(spark, table, tmp_path):
    docs = table([(i, f"text {i}") for i in range(5)]).coalesce(1)
    media.store(docs, str(tmp_path / "a"))
    archive = next((tmp_path / "a").glob("*.zip"))
    data = bytearray(archive.read_bytes())
    data[data.index(b"\x89PNG") + 50] ^= 1
    archive.write_bytes(bytes(data))
    rows = media.load(spark, str(tmp_path / "a"), on_error="row").collect()
    assert sorted(r.error is None for r in rows) == [False, True, True, True, True]
    with pytest.raises(Exception, match="damaged"):
        media.load(spark, str(tmp_path / "a")).collect()


def test_transient_error_is_retried(spark, table, tmp_path, monkeypatch):
    media.store(table([(1, "text")]), str(tmp_path / "a"))
    reader = media.ArchiveReader({"path": str(tmp_path / "a")})
    part = next(p for p in reader.partitions() if p.archive)
    filesystem, folder = media._filesystem(str(tmp_path / "a"))
    members = media._Members(filesystem, f"{folder}/{part.archive}")
    info = members.between(0, 1 << 40)[0]
    members.file.close()  # the first attempt meets a closed file
    assert media.from_png(members.read(info))[1] == 4


def test_append_and_overwrite(spark, table, tmp_path):
    path = str(tmp_path / "a")
    keys = lambda: sorted(int(r.key) for r in media.load(spark, path).select("key").collect())
    media.store(table([(i, f"text {i}") for i in range(6)]), path)
    media.store(table([(i, f"text {i}") for i in range(6, 8)]), path)
    assert keys() == list(range(8))
    media.store(table([(9, "new")]), path, mode="overwrite")
    assert keys() == [9] and len(list((tmp_path / "a").glob("manifest-*"))) == 1 and len(list((tmp_path / "a").glob("*.zip"))) == 1


def test_commit_removes_what_failed_attempts_left(tmp_path):
    import pyarrow as pa

    writer = media.ArchiveWriter({"path": str(tmp_path)})
    batch = pa.RecordBatch.from_arrays([pa.array(["k"]), pa.array([media.to_png(b"x")], pa.binary())], names=["key", "media"])
    lost, done = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([done, None])
    assert [p.name for p in tmp_path.glob("*.zip")] == [done.archives[0][0]] and lost.archives != done.archives


def test_damaged_image_is_a_value_error():
    image = media.to_png(b"hello world" * 20)
    for at in range(8, len(image), 7):
        with pytest.raises(ValueError):
            media.from_png(image[:at])


def test_empty_table(spark, table, tmp_path):
    media.store(table([]), str(tmp_path / "a"))
    assert media.load(spark, str(tmp_path / "a")).count() == 0


def test_feature_is_stable():
    samples = np.arange(64 * 20, dtype=np.int64).reshape(20, 64).astype(np.uint8)
    assert media.feature(samples) == media.feature(samples.copy())
