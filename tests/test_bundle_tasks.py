"""A bundle's files are dealt to tasks by their number, not listed through the driver."""

from __future__ import annotations

from strataloom.sources import bundle


def test_tasks_take_many_files(spark, tmp_path):
    nodes = spark.range(50).selectExpr("id as node_id", "'statement' as role", "'open' as status")
    bundle.export(nodes, spark.range(49).selectExpr("id as src", "id + 1 as dst"), str(tmp_path / "bundle"))
    got = bundle.load(spark, str(tmp_path / "bundle"))
    assert not got.inputFiles() or all(".md" not in f for f in got.inputFiles())
    assert got.rdd.getNumPartitions() == 4 and got.count() == 50
    assert bundle._tasks(spark, 7_200_000) == 360 and bundle._tasks(spark, 0) == 1
