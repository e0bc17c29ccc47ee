"""Registered queries and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.plans import media, more, records, rules  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**media.QUERIES, **records.QUERIES}  # more and rules add to records' registry


def oracle_sql() -> dict[str, str]:
    return {**media.SQL, **records.SQL}
