"""Named queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _load() -> None:
    from . import metric_queries, model_queries, report_queries, shape_queries, text_queries  # noqa: F401  (they register themselves)


_load()
