"""All core queries with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselode.plans import corpus_queries, nested_queries, retrieval_queries, stream_queries, usage_queries

_MODULES = (corpus_queries, retrieval_queries, usage_queries, stream_queries, nested_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval_queries.hybrid_search_full(spark, folder)
