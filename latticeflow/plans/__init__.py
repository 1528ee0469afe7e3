"""The catalogue of queries, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latticeflow.plans import lattice_queries, packed_queries, report_queries, run_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [lattice_queries, text_queries, run_queries, packed_queries, report_queries]


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
