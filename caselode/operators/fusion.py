"""Combining ranked lists: min-max, weighted sum, reciprocal ranks, rerank blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caselode.config import DEFAULT


def minmax(score: Column, *by: str) -> Column:
    """Score scaled to 0..1 within its list; a list of one score, or of equal scores, becomes 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return (score - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))


def _both(dense: DataFrame, sparse: DataFrame, key: str, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    one = dense.select(*by, key, F.col("score").alias("d_score"), F.col("rank").alias("d_rank"))
    two = sparse.select(*by, key, F.col("score").alias("s_score"), F.col("rank").alias("s_rank"))
    return one.join(two, [*by, key], "full_outer")


def _order(key: str) -> list[Column]:
    """By score; ties in the order of the first list, then of the second."""
    return [F.desc("score"), F.asc_nulls_last("d_rank"), F.asc_nulls_last("s_rank"), F.col(key)]


def weighted(dense: DataFrame, sparse: DataFrame, key: str, alpha: float | str = DEFAULT.alpha, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """alpha x norm(first) + (1 - alpha) x norm(second), 4 digits; a text missing on one side counts 0 there.

    ``alpha`` may name a column of ``by`` that both lists carry, for sweeps.
    """
    a = F.col(alpha) if isinstance(alpha, str) else F.lit(alpha)
    d = dense.withColumn("score", minmax(F.col("score"), *by))
    s = sparse.withColumn("score", minmax(F.col("score"), *by))
    score = F.round(a * F.coalesce("d_score", F.lit(0.0)) + (1 - a) * F.coalesce("s_score", F.lit(0.0)), 4)
    fused = _both(d, s, key, by).withColumn("score", score)
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*_order(key))))


def reciprocal_ranks(dense: DataFrame, sparse: DataFrame, key: str, k: int = DEFAULT.rrf_k) -> DataFrame:
    one = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    fused = _both(dense, sparse, key).withColumn("score", F.round(one("d_rank") + one("s_rank"), 6))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order(key))))


def rerank_blend(pool: DataFrame, logits: DataFrame, key: str, beta: float | str = DEFAULT.beta, depth: int | str = DEFAULT.depth, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first ``depth`` of each pool reordered by beta x norm(logit) + (1 - beta) x norm(retrieval); the tail keeps its order.

    A candidate without logit counts 0.0; a query without any logit keeps its retrieval order and says so in
    ``reranked``. Both norms are taken over the head. ``beta`` and ``depth`` may name columns of ``by``, for grids.
    """
    joined = pool.select(*by, key, "score", "rank").join(logits.select("query_id", key, "logit"), ["query_id", key], "left")
    whole = Window.partitionBy(*by)
    b = F.col(beta) if isinstance(beta, str) else F.lit(beta)
    d = F.col(depth) if isinstance(depth, str) else F.lit(depth)
    head = (
        joined.withColumn("reranked", F.count("logit").over(whole) > 0)
        .withColumn("logit", F.coalesce("logit", F.lit(0.0)))
        .withColumn("tail", F.col("rank") > d)
    )
    blend = F.round(b * minmax(F.col("logit"), *by, "tail") + (1 - b) * minmax(F.col("score"), *by, "tail"), 4)
    scored = head.withColumn("blend", F.when(F.col("tail") | ~F.col("reranked"), F.col("score")).otherwise(blend))
    order = [F.col("tail"), F.when(~F.col("tail"), -F.col("blend")), F.col("rank"), F.col(key)]
    return scored.withColumn("new_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).drop("tail")


def confidence(ranked: DataFrame, wide: float = 0.1, narrow: float = 0.02) -> DataFrame:
    """Label by the margin to the next hit: high from ``wide``, moderate from ``narrow``, else weak."""
    margin = F.col("score") - F.lead("score").over(Window.partitionBy("query_id").orderBy("rank"))
    label = F.when(margin >= wide, "high").when(margin >= narrow, "moderate").otherwise("weak")
    return ranked.withColumn("margin", F.round(margin, 6)).withColumn("confidence", label)
