"""Registered queries of the engine and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import er, variants  # noqa: F401  (variants registers its queries with er)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(er.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(er.ORACLE_SQL)
