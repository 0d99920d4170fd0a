"""All registered queries outside the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import check_queries, corpus_queries, evaluation_queries, export_queries, fact_queries, metric_queries, pack_queries, related_queries, run_queries, store_queries, stream_queries

MODULES = (fact_queries, corpus_queries, run_queries, evaluation_queries, related_queries, pack_queries, store_queries, stream_queries, metric_queries, export_queries, check_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
