"""The projection of an index makes the index once."""

from __future__ import annotations

from strataloom import catalog
from strataloom.operators import retrieve


def test_texts_are_read_once(spark):
    plan = catalog.queries()["q08_rebuild_projection"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    index = spark.createDataFrame([("a", 1, 2), ("a", 3, 1), ("b", 2, 9)], "token string, region_id long, tf long")
    assert [tuple(r) for r in retrieve.projection(index).collect()] == [("a", 2, 1, 2)]
