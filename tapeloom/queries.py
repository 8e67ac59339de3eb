"""All queries and their SQL, by topic."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TOPICS = ("factors", "bars", "features", "events", "markets", "signals", "alphas", "recursions", "measures")


def _modules() -> list:
    return [importlib.import_module(f"tapeloom.catalog.{t}") for t in TOPICS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _modules() for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.oracle_sql().items()}
