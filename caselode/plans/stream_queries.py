"""Streaming queries, run to the end of the given tables, with their batch equivalents in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselode.plans.corpus_queries import UPSERT_LATEST
from caselode.streaming import streams


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_windows(spark, d)


def stream_log_dedup(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_dedup(spark, d).select("correlation_id", "log_id")


def stream_upsert_cases(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_upsert(spark, d)


QUERIES = {f.__name__: f for f in (stream_event_windows, stream_log_dedup, stream_upsert_cases)}
ORACLE = {
    "stream_event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_log_dedup": "SELECT correlation_id, min(log_id) AS log_id FROM search_log GROUP BY correlation_id, CASE WHEN correlation_id IS NULL THEN log_id END",
    "stream_upsert_cases": UPSERT_LATEST,
}
