"""All queries of the library by name, and DuckDB SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import graph_queries, search_queries, table_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return search_queries.QUERIES | graph_queries.QUERIES | table_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return search_queries.ORACLES | graph_queries.ORACLES | table_queries.ORACLES
