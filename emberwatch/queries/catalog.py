"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberwatch.queries import detection, incident_flow, monitoring, preparation, sources_and_quality  # noqa: F401
from emberwatch.queries.base import REGISTRY, Query, finish, tables


def _runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: finish(q.build(tables(spark, folder)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(q) for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql is not None}
