"""Every query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codec_queries, file_queries, report_queries, series_queries  # noqa: F401  each adds its own


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(series_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in series_queries.ORACLES.items() if k in series_queries.QUERIES}
