"""Table access: Parquet scans with an optional row-count check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def verified_scan(spark: SparkSession, path: str, expected_rows: int) -> DataFrame:
    """Scan that raises ValueError when the row count differs from the manifest's."""
    df = spark.read.parquet(path)
    found = df.count()
    if found != expected_rows:
        raise ValueError(f"{path}: manifest says {expected_rows} rows, found {found}")
    return df
