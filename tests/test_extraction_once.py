"""A delta parses the extracted documents once."""

from __future__ import annotations

from strataloom.operators import validate


def test_documents_are_parsed_once(spark):
    raw = spark.createDataFrame([("d", '{"components":["p","p"],"obligations":["o"],"relations":[{"subject_id":"p","predicate":"r","object_id":"o"},null]}')], "object_id string, json string")
    got = validate.extraction_delta(raw, spark.createDataFrame([("r", "component", "obligation")], "relation string, src_type string, dst_type string"))
    assert "from_json" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {("upsert_node", "p", "ok"), ("upsert_node", "o", "ok"), ("add_edge", "p", "ok")} <= {(r.action, r.id, r.issue) for r in got.collect()}
