from __future__ import annotations

import itertools

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark, tmp_path):
    """Rows of (doc_id, text[, source]) as a written documents table, the stable scan that operators ask for."""
    number = itertools.count()

    def make(rows, extra=()):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", None) for r in rows]
        df = spark.createDataFrame(rows, SCHEMA)
        for name in extra:
            df = df.selectExpr("*", f"'x' as `{name}`")
        path = str(tmp_path / f"t{next(number)}")
        df.repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


#: Null, empty, long, repeated and odd texts.
HARD = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "a" * 5000), (6, "Ünï cödé 漢字 😀 <|endoftext|>"), (7, "x y z " * 2000), (4, "word"), (None, "no id"), (None, "no id")]


@pytest.fixture
def hard():
    return HARD
