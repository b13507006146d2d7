"""Structured Streaming counterparts: windows, deduplication and upsert over arriving files.

Each runs to the end of what is there (availableNow) and stops. State and output lie in ``place``; a later run with
the same place takes up where the last one ended and reads only files that are new. Without a place a fresh one
under the shared checkpoint folder is used. A table is a Parquet file or a folder of Parquet files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from caselode.session import ensure_checkpoint_dir
from caselode.sources import files


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of a table as a stream: its folder, or the one file picked out of the folder it lies in."""
    path = f"{folder}/{name}.parquet"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_file = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jvm_path).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if is_file else reader.parquet(path)


def _place(spark: SparkSession, name: str, place: str | None) -> str:
    return place or f"{ensure_checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def _finish(writer, place: str) -> None:
    query = writer.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling windows with a watermark; a window is given out once, when the watermark has passed its end."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, size), by).agg(F.count("*").alias("n"))


def run_windows(spark: SparkSession, folder: str, place: str | None = None) -> DataFrame:
    """Hourly counts by type. Every batch adds its own counts per hour (an epoch replaces itself when run again), so
    rows count however late they come, and no window is kept in memory; readers add up the parts of an hour."""
    place = _place(spark, "windows", place)
    events = stream(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")

    def add(batch: DataFrame, epoch: int) -> None:
        part = batch.groupBy(F.date_trunc("HOUR", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
        part.write.mode("overwrite").parquet(f"{place}/out/epoch={epoch}")

    _finish(events.writeStream.foreachBatch(add), place)
    return spark.read.parquet(f"{place}/out").groupBy("hour", "event_type").agg(F.sum("n").alias("n"))


def run_closed_windows(spark: SparkSession, folder: str, place: str | None = None, late: str = "2 hours") -> DataFrame:
    """The hours that the watermark has closed, in append mode: state of closed hours is freed, later rows of them are dropped."""
    place = _place(spark, "closed", place)
    counts = windowed_counts(stream(spark, folder, "events"), "ts", "event_type", late=late)
    told = counts.select(F.col("window.start").alias("hour"), "event_type", "n")
    _finish(told.writeStream.outputMode("append").format("parquet").option("path", f"{place}/out"), place)
    return spark.read.schema(told.schema).parquet(f"{place}/out")


def run_dedup(spark: SparkSession, folder: str, place: str | None = None) -> DataFrame:
    """Each request once, by its first log row, however late a row or its repetition arrives.

    Batches are merged into a versioned table by correlation id (rows without one by their own id): exact, where a
    watermark would drop late requests and forget early ones.
    """
    place = _place(spark, "dedup", place)
    log = stream(spark, folder, "search_log").select("correlation_id", "log_id")

    def merge(batch: DataFrame, epoch: int) -> None:
        keyed = batch.withColumn("key", F.coalesce("correlation_id", F.concat(F.lit("row "), F.col("log_id").cast("string"))))
        files.upsert(keyed.withColumn("first", -F.col("log_id")), f"{place}/out", ["key"], ["first"], version=epoch)

    _finish(log.writeStream.foreachBatch(merge), place)
    return files.read_versioned(spark, f"{place}/out").select("correlation_id", "log_id")


def run_upsert(spark: SparkSession, folder: str, place: str | None = None) -> DataFrame:
    """Cases as they arrive, merged batch by batch into a table of the latest version of each."""
    place = _place(spark, "upsert", place)
    cases = stream(spark, folder, "cases_clean").select("case_id", "row_no", "sex", "age", "outcome_class", "built_at")

    def merge(batch: DataFrame, epoch: int) -> None:
        files.upsert(batch, f"{place}/out", ["case_id"], ["built_at", "row_no"], version=epoch)

    _finish(cases.writeStream.foreachBatch(merge), place)
    return files.read_versioned(spark, f"{place}/out")
