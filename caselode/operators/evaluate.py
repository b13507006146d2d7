"""Ranking quality over a whole query set in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def hit_ranks(gold: DataFrame, ranked: DataFrame, key: str, rank: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., query_id, hit): rank of the first relevant text, null where none is listed. ``gold``: query_id, relevant (array)."""
    want = gold.select("query_id", F.explode("relevant").alias(key)).distinct()
    hits = ranked.join(F.broadcast(want) if gold.count() <= 100_000 else want, ["query_id", key]).groupBy(*by, "query_id").agg(F.min(rank).alias("hit"))
    settings = ranked.select(*by).distinct() if by else None
    every = gold.select("query_id").distinct()
    every = every.crossJoin(settings) if settings is not None else every  # stated queries x settings, a few rows
    return every.join(hits, [*by, "query_id"], "left")


def _metrics(k: int) -> list[Column]:
    hit = F.col("hit")
    recall = [F.round(F.avg(F.when(hit <= c, 1.0).otherwise(0.0)), 4).alias(f"recall_{c}") for c in (1, 5, 10)]
    near = F.when(hit <= k, hit)
    return [
        *recall,
        F.round(F.avg(F.coalesce(1.0 / near, F.lit(0.0))), 4).alias(f"mrr_{k}"),
        F.round(F.avg(F.coalesce(1.0 / F.log2(near + 1), F.lit(0.0))), 4).alias(f"ndcg_{k}"),
    ]


def metrics(hits: DataFrame, by: tuple[str, ...] = (), k: int = 10) -> DataFrame:
    """Hit rate at 1, 5, 10, MRR@k and nDCG@k over all gold queries."""
    return hits.groupBy(*by).agg(F.count("*").alias("queries"), *_metrics(k))


def best_setting(table: DataFrame, metric: str, order: list[str]) -> DataFrame:
    """The table with ``best``: the first setting in ``order`` that reaches the greatest value."""
    w = Window.orderBy(F.desc(metric), *order)  # one row per setting
    return table.withColumn("best", F.row_number().over(w) == 1)
