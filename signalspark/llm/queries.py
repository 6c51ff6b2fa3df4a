"""Loads the modules that register the queries of this folder."""

from __future__ import annotations

from importlib import import_module

from signalspark.llm.common import QUERIES, SQL

MODULES = (
    "decontaminate",
    "langid",
    "quality",
    "jaccard",
    "pieces",
    "token_counts",
    "suffixes",
    "fertility",
    "shards",
    "secrets",
    "ranked",
    "conversations",
    "licenses",
)


def load() -> tuple[dict, dict]:
    """Queries and SQL of the operators."""
    for module in MODULES:
        import_module(f"signalspark.llm.{module}")
    return QUERIES, SQL
