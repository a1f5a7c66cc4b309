"""All queries of the boundary-drift engine with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import checks, links, paths, records


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**checks.QUERIES, **records.QUERIES, **links.QUERIES, **paths.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**checks.ORACLE, **records.ORACLE, **links.ORACLE, **paths.ORACLE}
