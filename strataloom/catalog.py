"""The queries of every module, by name."""

from __future__ import annotations

from importlib import import_module

#: Modules with a QUERIES table and an SQL table.
MODULES: list[str] = ["store", "retrieval", "graph", "logic", "checks", "documents", "composites", "contracts", "traversal", "commits", "horn", "literature"]


def gathered(kind: str) -> dict:
    """The tables of all modules as one; a name that two of them use is an error."""
    out: dict = {}
    for module in MODULES:
        found = getattr(import_module(f"strataloom.plans.{module}"), kind)
        if twice := out.keys() & found.keys():
            raise ValueError(f"{module} names queries again: {sorted(twice)}")
        out |= found
    return out


def queries() -> dict:
    return gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    return gathered("SQL")
