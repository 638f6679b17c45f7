"""All queries over the driver's tables, with their SQL oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["retrieval", "corpus", "datasets", "models", "storage"]

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in _queries:
        raise ValueError(f"query {name} is registered already")
    _queries[name] = query
    if sql:
        _oracles[name] = sql


def _load() -> None:
    """The modules below register their queries when they are first imported."""
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and sparse recall of every benchmark item, fused, reranked and put in one numbered context."""
    _load()
    return _queries["p12_context_string"](spark, sf_dir)
