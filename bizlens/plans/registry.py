"""Aggregates the registered queries of all plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog


def _load() -> dict:
    # Importing a plan module registers its queries in catalog.REGISTRY.
    from . import catalog_models, catalog_more  # noqa: F401
    return catalog.REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: fn for k, (fn, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _load().items() if sql}
