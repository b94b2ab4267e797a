"""The pipeline's stages on planted rows."""

from __future__ import annotations

import corpus_pipeline as pipeline


def test_stages(spark, table, tmp_path):
    text = lambda i: " ".join(f"w{(i * 37 + j * j) % 997}" for j in range(80))
    rows = [(i, text(i), f"s{i % 3}") for i in range(12)] + [(100, text(1), "s0"), (101, text(2).replace("w", "w", 1) + " tail", "s1"), (102, None, "s2"), (103, "", "s0")]
    docs = table(rows, extra=["key", "u"])
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    counts = []
    for n, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n + 1 < len(pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[:3] == [16, 14, 13]  # nothing rejected; two copies (one of them the empty text); one near copy
    assert counts[3] == counts[4] > 0 and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_input(spark, table, tmp_path):
    docs = table([])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0
