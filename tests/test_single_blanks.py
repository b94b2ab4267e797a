"""Normalised texts: runs of white space become one space, and single spaces are left alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.llm.exact_dedup import normalised


def test_only_runs_are_replaced(spark):
    rows = spark.createDataFrame([("a b  c\t\nd   e",), ("a b",), ("  ",), ("",)], "t string").select(normalised(F.col("t")).alias("n"))
    assert [r.n for r in rows.collect()] == ["a b c d e", "a b", " ", ""]
    assert " {2,}" in rows._jdf.queryExecution().optimizedPlan().toString()
