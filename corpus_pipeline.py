"""The corpus pipeline: five stages from documents to encoded training text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and reads again as the next stage's docs. A stage begins by removing the tables that the
stages before it wrote for themselves, unless its docs still read them.

Defined results, for all stages: extra columns of any name pass through; an empty table gives an empty
result; a null text counts as empty (no copy of a text that isn't empty, no word, the two ids of begin and
end); repeated rows are equal texts, of which the exact stage keeps the first; ties go to the least id. A
text's length changes nothing: every stage reads it whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import exact_dedup, mixing, near_dedup, quality, sentencepieces
from strataloom.llm.common import documents, written
from strataloom.sources.shared import MADE, release

#: SQL can't express the classifier, the near duplicates or the encoding; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier finds bad or toxic."""
    return quality.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of equal texts."""
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return near_dedup.kept_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes sources in proportion to their weights; a document taken twice is there twice."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mix: its number of tokens and the digests of ids and decoded text."""
    import public_tokenizers

    return sentencepieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that stages wrote for themselves and that haven't been removed, by stage.
_left: dict[str, list[str]] = {}


def tidy(name: str, stage: Stage) -> Stage:
    """The stage, begun by removing what other stages left behind: their results are written by then."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for other in [n for n in _left if n != name]:
            _left[other] = release(spark, _left[other], docs)
        before = len(MADE)
        out = stage(spark, docs, sf_dir)
        _left.setdefault(name, []).extend(MADE[before:])
        return out

    return run_stage


STAGES = [(name, tidy(name, stage)) for name, stage in (("quality", classify), ("exact", drop_copies), ("near", drop_near_copies), ("mix", mix), ("encode", encode))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[-1][0]:
            _left[name].append(MADE[-1])
    return docs
