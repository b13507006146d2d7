"""Joins and groupings that survive keys holding a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 8


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than cores (a few small files) dealt over all cores; a larger one as it is.

    For narrow plans over files, before work that is heavy per row; select the columns needed first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted, reading no more); else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salt_of(*columns: str | Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Inner join in which a key of ``big`` may hold a third of its rows.

    ``spread`` names columns of ``big`` whose hash deals the rows of one key to ``salts`` parts;
    each row of ``small`` is repeated once per part. Null keys match nothing, as in any equi-join.
    """
    left = big.withColumn("_salt", salt_of(*spread, salts=salts))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"]).drop("_salt")
