"""All queries of the engine by name, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.plans import act_queries, audit_queries, enrich_queries, graph_build_queries, link_queries, read_queries, reference_queries, row_queries, rule_queries, search_queries, tree_queries

_MODULES = (tree_queries, search_queries, row_queries, rule_queries, link_queries, graph_build_queries, enrich_queries, reference_queries, act_queries, audit_queries, read_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.hybrid_retrieve(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
