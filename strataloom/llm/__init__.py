"""Operators for training-data pipelines, and the queries that apply them to whole tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ["media", "licenses", "exact_dedup", "near_dedup", "quality", "sentencepieces", "sharding", "suffixes", "mixing", "token_counts", "spelling", "embeddings", "infilling"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").SQL.items()}
