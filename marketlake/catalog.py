"""The registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import indicators, lake, market, marts, storage, streams

_PLANS = [market, marts, indicators, lake, storage, streams]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
