"""Bundles as files: round trips, edits, missing files, taken places."""

from __future__ import annotations

import os

import pytest

from strataloom.sources import bundle


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame([(i, "claim" if i % 2 else "proof of x", "open") for i in range(30)], "node_id long, role string, status string")
    edges = spark.createDataFrame([(i, (i * 7) % 30) for i in range(20)] + [(3, 4), (3, 4)], "src long, dst long")
    return nodes, edges


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".md"))


def test_round_trip_and_a_file_for_each_node(spark, graph, tmp_path):
    path = str(tmp_path / "bundle")
    bundle.export(*graph, path)
    assert len(files(path)) == 31 and os.listdir(tmp_path) == ["bundle"]
    got = {r.node_id: r for r in bundle.load(spark, path).collect()}
    assert len(got) == 30 and got[3].requires == "4,21" and got[2].role == "proof of x" and got[25].requires == ""


def test_edits_and_missing_files_are_errors(spark, graph, tmp_path):
    path = str(tmp_path / "bundle")
    bundle.export(*graph, path)
    one = next(f for f in files(path) if f.endswith("/3.md"))
    with open(one) as f:
        text = f.read()
    with open(one, "w") as f:
        f.write(text.replace("open", "closed"))
    for crc in [f for d, _, names in os.walk(path) for f in (os.path.join(d, n) for n in names) if f.endswith(".crc")]:
        os.remove(crc)
    with pytest.raises(Exception, match="edited bundle file"):
        bundle.load(spark, path).collect()
    os.remove(one)
    with pytest.raises(ValueError, match="30 files, there are 29"):
        bundle.load(spark, path)


def test_a_taken_place_stays_as_it_is(spark, graph, tmp_path):
    path = str(tmp_path / "bundle")
    bundle.export(*graph, path)
    before = files(path)
    with pytest.raises(Exception, match="already exists"):
        bundle.export(*graph, path)
    assert files(path) == before and os.listdir(tmp_path) == ["bundle"]


def test_an_attempt_that_fails_leaves_nothing(spark, graph, tmp_path):
    writer = bundle.BundleWriter(str(tmp_path / "bundle"))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"name": ["a/1"], "text": ["x"]})
    lost, told = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.folder != told.folder
    writer.commit([told])
    assert len(files(str(tmp_path / "bundle"))) == 2
    other = bundle.BundleWriter(str(tmp_path / "other"))
    other.write(iter([batch]))
    other.abort([None])
    assert os.listdir(tmp_path) == ["bundle"]


def test_an_empty_bundle(spark, graph, tmp_path):
    nodes, edges = graph
    path = str(tmp_path / "empty")
    bundle.export(nodes.filter("node_id < 0"), edges, path)
    assert bundle.load(spark, path).count() == 0
