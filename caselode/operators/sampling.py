"""Bounded samples whose size does not depend on how many rows or partitions there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_PARTS = 1 << 40


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """About ``rows`` rows, never more, chosen by hash of the (unique) key: the same ones for the same table, in the same
    order, however the table is partitioned.

    One counting pass sets the share of hash values to keep, so partitions send only chosen rows; the few beyond
    ``rows`` are those of the greatest hash.
    """
    n = df.count()
    share = int(_PARTS * rows * 0.95 / n) if n > rows else _PARTS
    at = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_PARTS))
    return df.where(at < share).orderBy(at, key, F.xxhash64(*df.columns)).limit(rows)
