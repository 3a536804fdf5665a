"""All queries of the core engine with their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemoframe.plans import graph, ingest, ledger, measures, ranking, records, retrieval, searches

MODULES: list = [ranking, graph, ledger, ingest, retrieval, records, searches, measures]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
