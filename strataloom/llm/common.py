"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written

__all__ = ["ROW", "column", "documents", "numbered", "shared_dir", "text_of", "without", "written"]

ROW = "__row"


def column(name: str) -> Column:
    """A column by its name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """df as a written table of __row, a number for each row, and doc, a struct of all columns.

    The number comes from the place in the scan, which depends on how Spark splits the files, so it is
    written once together with what it numbers: later jobs read both from this table, however many
    executors have come or gone since. Columns of any name live in the struct, apart from private ones.
    """
    return written(df.select(F.monotonically_increasing_id().alias(ROW), F.struct(*[column(c) for c in df.columns]).alias("doc")), "rows")


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The numbered rows whose number isn't among the dropped ones (column __row), as they were before.

    The dropped numbers are written first, so that Spark knows their size and sends them to the rows
    if they are few enough; only otherwise are the texts shuffled to meet them.
    """
    gone = written(dropped.select(F.col(ROW).alias("gone")), "dropped")
    return rows.join(gone, rows[ROW] == gone["gone"], "left_anti").select("doc.*")


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
