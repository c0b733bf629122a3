"""Registered queries over the engine's own operators, each with its DuckDB oracle where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds a query and its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    """Imports the modules whose queries register themselves."""
    import importlib

    for m in ("word_queries", "article_queries", "rule_queries", "tokenizer_queries", "vector_queries", "scoring_queries", "encoding_queries", "source_queries"):
        importlib.import_module(f"corpusloom.plans.{m}")
