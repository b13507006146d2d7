"""Approximate dense search over an inverted-file index.

Cell centres are fitted on a bounded sample (SAMPLE_ROWS vectors); every row is indexed. A search reads the cells
nearest to each query, so its work is about nprobe / cells of the exact search. How many cells to read is measured
on the sample: the fewest that hold RECALL of the sample queries' true neighbours. Recall over all rows against
brute force is measured in the tests. Nulls and vectors of another length or of length 0 are not indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from caselode.operators.retrieve import QUERY_BLOCK, _unit, best_columns, top_per_query, usual_length
from caselode.operators.sampling import bounded_sample

SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 300
RECALL = 0.95


def probes_needed(x: np.ndarray, centres: np.ndarray, n: int, seed: int = 7) -> int:
    """The fewest cells that hold RECALL of the n nearest sample rows of some sample rows."""
    if len(x) < 2:
        return len(centres)
    q = x[np.random.default_rng(seed).choice(len(x), min(SAMPLE_QUERIES, len(x)), replace=False)]
    m = min(n, len(x))
    nearest = np.argpartition(-(q @ x.T), m - 1, axis=1)[:, :m]
    cell = (x @ centres.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)  # how near each cell is to each query
    wanted = np.sort(np.take_along_axis(place, cell[nearest], 1).ravel())
    return int(wanted[min(len(wanted) - 1, int(np.ceil(RECALL * len(wanted))))]) + 1


def usual_cells(rows: int) -> int:
    """About the square root of the rows; at least 20 sample rows a cell."""
    return max(16, min(math.isqrt(rows), SAMPLE_ROWS // 20))


def laid_out(index: DataFrame) -> DataFrame:
    """The index dealt and sorted by cell: written so, a search skips the row groups of cells it does not ask."""
    parts = max(index.sparkSession.sparkContext.defaultParallelism, index.rdd.getNumPartitions())
    return index.repartition(parts, "cell").sortWithinPartitions("cell")


def fit_cells(df: DataFrame, key: str, vector: str, cells: int | None = None, n: int = 10, rounds: int = 10, seed: int = 7) -> tuple[np.ndarray, int]:
    """(centres, nprobe): unit vectors by spherical k-means on the sample, and the cells a search for ``n`` reads."""
    told = df.select(F.col(key), F.col(vector)).where(f"`{key}` is not null and size(`{vector}`) > 0")
    size = usual_length(df, vector)
    rows = sorted(bounded_sample(told.where(F.size(vector) == size), key, SAMPLE_ROWS).collect(), key=lambda r: r[0])
    x = _unit(np.array([r[1] for r in rows if len(r[1]) == size], dtype=np.float64).reshape(-1, size))
    x = x[np.isfinite(x).all(axis=1)]
    k = min(cells or usual_cells(told.count()), max(1, len(x)))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)] if len(x) else np.zeros((1, size))
    for _ in range(rounds if len(x) else 0):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = np.abs(sums).sum(axis=1) > 0
        centres[full] = _unit(sums[full])
    return centres, probes_needed(x, centres, n)


def index_rows(df: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
    """(key, vector, cell) of every row; write it partitioned or sorted by cell to let searches skip files."""
    sent = df.sparkSession.sparkContext.broadcast(centres)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        for batch in batches:
            keep = [v is not None and len(v) == c.shape[1] for v in batch["v"]]
            batch = batch[keep]
            if not len(batch):
                continue
            x = _unit(np.vstack(batch["v"].to_numpy()).astype(np.float64))
            good = np.isfinite(x).all(axis=1)
            batch = batch[good]
            if len(batch):
                yield pd.DataFrame({key: batch["k"], vector: batch["v"], "cell": (x[good] @ c.T).argmax(axis=1)})

    return df.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("k is not null and v is not null").mapInPandas(
        run, f"`{key}` {kind}, `{vector}` array<double>, cell int"
    )


def ann_topn(index: DataFrame, queries: DataFrame, centres: np.ndarray, n: int, key: str, vector: str, nprobe: int) -> DataFrame:
    """(query_id, key, score, rank): the best ``n`` of the rows in each query's ``nprobe`` nearest cells."""
    spark = index.sparkSession
    kind = index.schema[key].dataType.simpleString()
    some = queries.select(F.col(key).alias("k"), F.col(vector).alias("v")).where(f"`{key}` is not null and size(`{vector}`) = {centres.shape[1]}")
    blocks = -(-some.count() // QUERY_BLOCK) or 1
    found = None
    for i in range(blocks):
        rows = some.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == i).collect()
        q = _unit(np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), centres.shape[1]))
        near = np.argsort(-(q @ centres.T), axis=1)[:, :nprobe]
        asking: dict[int, np.ndarray] = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        sent = spark.sparkContext.broadcast((np.array([r["k"] for r in rows]), q, asking))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, q, asking = sent.value
            for batch in batches:
                for cell, rows in batch.groupby("cell"):
                    who = asking.get(int(cell))
                    if who is None or not len(who):
                        continue
                    keys = rows[key].to_numpy()
                    scores = np.round(q[who] @ _unit(np.vstack(rows[vector].to_numpy()).astype(np.float64)).T, 6)
                    m = min(n, len(keys))
                    order = best_columns(scores, keys, m)
                    yield pd.DataFrame({"query_id": np.repeat(names[who], m), key: keys[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})

        # cells nobody asks for are not read
        part = index.where(F.col("cell").isin([int(c) for c in asking])).mapInPandas(run, f"query_id {kind}, `{key}` {kind}, score double")
        found = part if found is None else found.unionByName(part)
    return top_per_query(found, n, [F.desc("score"), F.col(key)])
