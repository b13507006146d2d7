"""Dense and sparse retrieval: exact top lists per query."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from caselode.functions.text import tokens
from caselode.operators.skew import broadcast_if_small, salted_join
from caselode.session import cut_lineage

QUERY_BLOCK = 2000


def top_per_query(scored: DataFrame, n: int, order: list[Column], query: str = "query_id") -> DataFrame:
    """The first ``n`` rows of each query with their rank; the window is cut to n before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= n)


def usual_length(df: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors (the smaller one on ties); 0 without any."""
    by = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("c"))
    found = by.agg(F.max_by("n", F.struct("c", -F.col("n")))).first()[0]
    return int(found or 0)


def best_columns(scores: np.ndarray, keys: np.ndarray, m: int) -> np.ndarray:
    """Per row the places of the ``m`` best columns, best first, ties by key: only what reaches the m-th best is sorted.

    Scores are numbers; what has none is given as minus infinity.
    """
    if m >= scores.shape[1]:
        return np.lexsort((np.broadcast_to(keys, scores.shape), -scores))
    limit = -np.partition(-scores, m - 1, axis=1)[:, m - 1]
    out = np.empty((len(scores), m), dtype=np.int64)
    for i, (row, least) in enumerate(zip(scores, limit)):
        few = np.flatnonzero(row >= least)
        out[i] = few[np.lexsort((keys[few], -row[few]))[:m]]
    return out


def dense_topn(corpus: DataFrame, queries: DataFrame, n: int, key: str = "vec_id", vector: str = "embedding", skip_self: bool = False, dim: int | None = None) -> DataFrame:
    """Exact cosine top ``n`` of each query vector against all corpus vectors: query_id, key, score (6 digits), rank.

    The stated queries go to the tasks in blocks of QUERY_BLOCK vectors; every Arrow batch is one matrix product
    of which each query's n best rows are passed on, so the shuffle carries candidates, not scores.
    Vectors that are null, of another length than ``dim`` (by default the corpus's most frequent one) or of length 0
    have no score. Ties: the smaller key.
    """
    spark = corpus.sparkSession
    kind, qkind = corpus.schema[key].dataType.simpleString(), queries.schema[key].dataType.simpleString()
    some = queries.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("k is not null and v is not null")
    size = usual_length(corpus, vector) if dim is None else dim
    blocks = -(-some.count() // QUERY_BLOCK) or 1
    found = None
    for i in range(blocks):
        rows = some.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == i).collect()
        if not rows and i:
            continue
        rows = [r for r in rows if len(r["v"]) == size]
        sent = spark.sparkContext.broadcast(([r["k"] for r in rows], _unit(np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), size))))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, q = sent.value
            for batch in batches:
                keep = [j for j, v in enumerate(batch["v"]) if v is not None and len(v) == q.shape[1]]
                if not keep or not names:
                    continue
                keys = batch["k"].to_numpy()[keep]
                x = _unit(np.vstack(batch["v"].to_numpy()[keep]).astype(np.float64))
                scores = np.nan_to_num(np.round(q @ x.T, 6), nan=-np.inf)
                m = min(len(keys), n + 1)
                order = best_columns(scores, keys, m)
                yield pd.DataFrame({"query_id": np.repeat(np.array(names), m), key: keys[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})

        part = corpus.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("k is not null").mapInPandas(
            run, f"query_id {qkind}, `{key}` {kind}, score double"
        )
        found = part if found is None else found.unionByName(part)
    found = found.where("score >= -1.5")
    if skip_self:
        found = found.where(F.col("query_id") != F.col(key))
    return top_per_query(found, n, [F.desc("score"), F.col(key)])


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, term, qtf)."""
    return (
        queries.select(F.col(key).alias("query_id"), F.explode_outer(tokens(F.col(text))).alias("term"))
        .where("term is not null")
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def sparse_scores(corpus: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(query_id, key, score): term-frequency dot product over the square root of the text's length in tokens.

    Only words of the queries leave the scan: the stated query set's terms are broadcast when there are at most
    BROADCAST_TERMS of them, and joined by shuffle beyond that. Integer products keep sums exact.
    """
    words = corpus.select(F.col(key), tokens(F.col(text)).alias("w"))
    # outer, so that no filter that would part the text a second time is inferred; null terms join nothing
    each = words.select(key, F.size("w").alias("len"), F.explode_outer("w").alias("term"))
    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        # each occurrence adds the term's weight in the query: no shuffle before the sums
        hits = each.join(F.broadcast(terms), "term").groupBy("query_id", key, "len").agg(F.sum("qtf").alias("dot"))
    else:
        tf = each.join(terms.select("term").distinct(), "term", "left_semi").groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
        joined = salted_join(tf, terms, ["term"], [key])
        hits = joined.groupBy("query_id", key, "len").agg(F.sum(F.col("tf") * F.col("qtf")).alias("dot"))
    return hits.select("query_id", key, F.round(F.col("dot") / F.sqrt("len"), 6).alias("score"))


BROADCAST_TERMS = 200_000


def sparse_topn(corpus: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, n: int) -> DataFrame:
    """Top ``n`` texts sharing a term with each query. Ties: the smaller key."""
    scored = sparse_scores(corpus, key, text, query_terms(queries, query_key, query_text))
    return top_per_query(scored, n, [F.desc("score"), F.col(key)])


def postings(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, len): how often each word stands in each text. Laid out by text and sorted by term when written
    with ``laid_out``, so that a query reads only the row groups of its terms and adds up a text's words in one place."""
    words = corpus.select(F.col(key), tokens(F.col(text)).alias("w"))
    each = words.select(key, F.size("w").alias("len"), F.explode_outer("w").alias("term")).where("term is not null")
    return each.groupBy(key, "len", "term").agg(F.count("*").alias("tf"))


def laid_out(index: DataFrame, key: str) -> DataFrame:
    parts = max(index.sparkSession.sparkContext.defaultParallelism, index.rdd.getNumPartitions())
    return index.repartition(parts, key).sortWithinPartitions("term", key)


def term_stats(index: DataFrame) -> DataFrame:
    """(term, df, top): in how many texts a term stands, and the most one occurrence of it in a query can add to a score."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.max(F.col("tf") / F.sqrt("len")).alias("top"))


PRUNE_HITS = 20_000_000
_SLACK = 2e-6  # scores are rounded to six digits


def postings_topn(index: DataFrame, stats: DataFrame, key: str, terms: DataFrame, n: int, within: DataFrame | None = None, prune_hits: int = PRUNE_HITS) -> DataFrame:
    """Exact top ``n`` texts of each query over a postings table: query_id, key, score (6 digits), rank. Ties: the smaller key.

    terms: (query_id, term, qtf); ``within`` limits the texts to some keys. Where the queries' words stand in very many
    texts (over ``prune_hits`` query-term-text hits) words that nearly every text has are not counted out: the n-th best
    score from the rare words of a query is a bound; common words whose greatest contributions together stay
    below it can't bring a text into the list, so only texts with some other word are candidates, and only theirs
    are completed. The result is the same.
    """
    index = index.join(within.select(key), key, "left_semi") if within is not None else index
    known = terms.join(stats, "term", "left")
    size = known.agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("hits")).first()
    if size["hits"] <= prune_hits:
        sums = _dots(index, key, terms, size["terms"])
        return top_per_query(sums.select("query_id", key, F.round(F.col("dot") / F.sqrt("len"), 6).alias("score")), n, [F.desc("score"), F.col(key)])
    # one row per query and term from here on
    known = cut_lineage(known.where("df is not null").select("query_id", "term", "qtf", "df", (F.col("qtf") * F.col("top")).alias("most")))
    by = Window.partitionBy("query_id")
    rarest = known.withColumn("at", F.row_number().over(by.orderBy("df", "term"))).withColumn("all", F.count("*").over(by))
    first = _dots(index, key, rarest.where("at <= ceil(all / 3)").select("query_id", "term", "qtf"))
    first = top_per_query(first.select("query_id", key, F.round(F.col("dot") / F.sqrt("len"), 6).alias("score")), n, [F.desc("score"), F.col(key)])
    bound = first.where(F.col("rank") == n).select("query_id", F.col("score").alias("bound"))
    common = known.withColumn("upto", F.sum("most").over(by.orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)))
    split = cut_lineage(
        common.join(bound, "query_id", "left").withColumn("needed", F.coalesce(F.col("upto") + _SLACK >= F.col("bound"), F.lit(True)))
    )
    slack = split.groupBy("query_id").agg(F.coalesce(F.max(F.when(~F.col("needed"), F.col("upto"))), F.lit(0.0)).alias("slack"), F.coalesce(F.first("bound"), F.lit(0.0)).alias("bound"))
    some = _dots(index, key, split.where("needed").select("query_id", "term", "qtf")).join(broadcast_if_small(slack), "query_id")
    some = some.where(F.col("dot") / F.sqrt("len") + F.col("slack") + _SLACK >= F.col("bound")).select("query_id", key, "len", "dot")
    some = cut_lineage(some)
    rest = split.where("not needed").select("query_id", "term", "qtf")
    words = index.join(broadcast_if_small(rest.select("term").distinct()), "term", "left_semi").select(key, "term", "tf")
    more = some.select("query_id", key).join(words, key).join(broadcast_if_small(rest), ["query_id", "term"])
    more = more.groupBy("query_id", key).agg(F.sum(F.col("tf") * F.col("qtf")).alias("more"))
    whole = some.join(more, ["query_id", key], "left").withColumn("dot", F.col("dot") + F.coalesce("more", F.lit(0)))
    return top_per_query(whole.select("query_id", key, F.round(F.col("dot") / F.sqrt("len"), 6).alias("score")), n, [F.desc("score"), F.col(key)])


def _dots(index: DataFrame, key: str, terms: DataFrame, counted: int | None = None) -> DataFrame:
    """(query_id, key, len, dot) over the texts that hold any of the terms, of which there are ``counted``."""
    few = terms.limit(BROADCAST_TERMS + 1).count() if counted is None else counted
    joined = index.join(F.broadcast(terms), "term") if few <= BROADCAST_TERMS else salted_join(index, terms, ["term"], [key])
    return joined.groupBy("query_id", key, "len").agg(F.sum(F.col("tf") * F.col("qtf")).alias("dot"))


def sparse_topn_blocks(corpus: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, n: int) -> DataFrame:
    """``sparse_topn`` for many long queries: each partition passes on its n best texts of a query, not all pairs.

    The terms of a block of QUERY_BLOCK queries go to the tasks; a text adds each of its words' weights to the
    queries that hold the word. Keys are integers without nulls.
    """
    spark = corpus.sparkSession
    kind, qkind = corpus.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    terms = query_terms(queries, query_key, query_text)
    blocks = -(-queries.select(query_key).distinct().count() // QUERY_BLOCK) or 1
    words = corpus.select(F.col(key).alias("k"), tokens(F.col(text)).alias("w")).where(F.size("w") > 0)
    found = None
    for i in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
        names = sorted({r["query_id"] for r in rows})
        place = {name: j for j, name in enumerate(names)}
        held: dict[str, list[tuple[int, int]]] = {}
        for r in rows:
            held.setdefault(r["term"], []).append((place[r["query_id"]], r["qtf"]))
        weights = {t: (np.array([j for j, _ in x]), np.array([c for _, c in x], dtype=np.float64)) for t, x in held.items()}
        sent = spark.sparkContext.broadcast((names, weights))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, weights = sent.value
            best = None
            for batch in batches:
                for at in range(0, len(batch), SPARSE_ROWS):
                    part = batch.iloc[at : at + SPARSE_ROWS]
                    dots = np.zeros((len(part), len(names)))
                    for row, words in zip(dots, part["w"]):
                        for term, tf in Counter(words).items():
                            if (hit := weights.get(term)) is not None:
                                row[hit[0]] += tf * hit[1]
                    lens = part["w"].map(len).to_numpy(dtype=np.int64)
                    new = (np.broadcast_to(part["k"].to_numpy()[None], dots.T.shape), dots.T, np.broadcast_to(lens[None], dots.T.shape))
                    best = new if best is None else tuple(np.concatenate(pair, axis=1) for pair in zip(best, new))
                    scores = np.floor(best[1] / np.sqrt(best[2]) * 1e6 + 0.5)
                    order = np.lexsort((best[0], -scores))[:, :n]
                    best = tuple(np.take_along_axis(x, order, 1) for x in best)
            if best is not None and names:
                keep = best[1].ravel() > 0
                columns = (np.repeat(np.array(names), best[0].shape[1]), *(x.ravel() for x in best))
                yield pd.DataFrame({c: x[keep] for c, x in zip(("query_id", key, "dot", "len"), columns)}).astype({"dot": "int64"})

        part = words.mapInPandas(run, f"query_id {qkind}, `{key}` {kind}, dot long, len long")
        found = part if found is None else found.unionByName(part)
    scored = found.select("query_id", key, F.round(F.col("dot") / F.sqrt("len"), 6).alias("score"))
    return top_per_query(scored, n, [F.desc("score"), F.col(key)])


SPARSE_ROWS = 1000
