"""Text and JSON sources with counted errors; sinks that can be run again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from caselode.operators.corpus import latest_wins
from caselode.session import ensure_checkpoint_dir


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of a JSON-lines source: blank lines are skipped, lines that are no JSON object are counted and dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    ok = F.expr("try_variant_get(try_parse_json(value), '$', 'map<string,variant>')").isNotNull()
    marked = lines.withColumn("ok", ok)
    rows = marked.where("ok").select(F.from_json("value", schema).alias("r")).select("r.*")
    counts = marked.agg(F.count("*").alias("read"), F.count_if(~F.col("ok")).alias("record_parse_error"))
    return rows, counts


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that is one JSON document (an object, or an array of objects)."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def find_sources(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files below a folder whose name matches, sorted; the first is the one to use."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return sorted(r["path"] for r in found.select("path").collect())


def first_source(spark: SparkSession, folder: str, pattern: str, prefer: tuple[str, ...] = ()) -> str | None:
    """The file to use: of those whose name matches the first whose path holds the earliest of ``prefer``, else by name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    rank = F.lit(len(prefer))
    for i, part in reversed(list(enumerate(prefer))):
        rank = F.when(F.contains("path", F.lit(part)), i).otherwise(rank)
    best = found.select("path", rank.alias("rank")).orderBy("rank", "path").limit(1).collect()
    return best[0]["path"] if best else None


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_missing(df: DataFrame, path: str, key: str) -> None:
    """Resumable append: only rows whose key is not there yet are added, so a run cut short can be repeated."""
    spark = df.sparkSession
    todo = df.join(spark.read.parquet(path).select(key), key, "left_anti") if _exists(spark, path) else df
    todo.write.mode("append").parquet(path)


def _pointer(spark: SparkSession, path: str):
    """(file system, versions) of a versioned table: a version counts once its empty marker file is there."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = jvm.org.apache.hadoop.fs.Path(path, "_versions")
    found = [int(s.getPath().getName()) for s in fs.listStatus(marks)] if fs.exists(marks) else []
    return fs, marks, sorted(found)


def read_versioned(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest finished version of a table written by ``upsert``; None if there is none."""
    found = _pointer(spark, path)[2]
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


def upsert(df: DataFrame, path: str, keys: list[str], order: list[str], version: int | None = None, keep: int = 2) -> None:
    """Idempotent upsert: per key the row of greatest ``order`` among old and new ones.

    The merged table is written as a new version and becomes the current one when its marker file is created, which
    is one atomic step: a run cut short leaves the version before it. ``version`` (an epoch of a stream) makes running
    the same step again harmless. The last ``keep`` versions stay.
    """
    spark = df.sparkSession
    fs, marks, found = _pointer(spark, path)
    if version is not None and version in found:
        return
    number = (found[-1] + 1 if found else 0) if version is None else version
    both = spark.read.parquet(f"{path}/v={found[-1]}").unionByName(df, allowMissingColumns=True) if found else df
    latest_wins(both, keys, order).write.mode("overwrite").parquet(f"{path}/v={number}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs.create(hadoop(marks, str(number)), True).close()
    for old in [*found, number][:-keep]:
        fs.delete(hadoop(marks, str(old)), False)
        fs.delete(hadoop(path, f"v={old}"), True)


def read_csv(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of a CSV source with a header: rows with a value that is not of its type are counted and dropped."""
    fields = T.StructType.fromDDL(schema).fields
    raw = spark.read.option("header", True).schema(T.StructType([T.StructField(f.name, T.StringType()) for f in fields])).csv(path)
    typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields]
    bad = reduce(lambda a, b: a | b, [F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull() for f in fields])
    counts = raw.agg(F.count("*").alias("read"), F.count_if(bad).alias("record_parse_error"))
    return raw.where(~bad).select(*typed), counts


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def delete_where(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted): rows for which the predicate is true are deleted; where it is null they stay."""
    gone = F.coalesce(predicate, F.lit(False))
    return df.where(~gone), df.where(gone)


def stored_table(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, built once and read again while its inputs stay the same.

    It lies beside the checkpoints under its name and a digest of the inputs' file names, sizes and times; what a
    build cut short has left has no success mark and is written anew.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    seen = []
    for path in inputs:
        fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        listed = fs.listFiles(hadoop(path), True)
        while listed.hasNext():
            one = listed.next()
            seen.append(f"{one.getPath()} {one.getLen()} {one.getModificationTime()}")
    digest = hashlib.blake2b("\n".join(sorted(seen)).encode(), digest_size=12).hexdigest()
    path = f"{ensure_checkpoint_dir(spark)}/stored/{name}-{digest}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def markdown_table(df: DataFrame, best: list[str] | None = None, limit: int = 200) -> str:
    """A small result as a Markdown table; in columns named in ``best`` the greatest value is bold."""
    rows = df.limit(limit).collect()
    top = {c: max((r[c] for r in rows if r[c] is not None), default=None) for c in best or []}
    cell = lambda c, v: f"**{v}**" if c in top and v is not None and v == top[c] else "" if v is None else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(c, r[c]) for c in df.columns) + " |" for r in rows])


def json_report(**counts: DataFrame) -> str:
    """Small results as one JSON object: a result of one row as an object, any other as a list of objects."""
    told = {}
    for name, df in counts.items():
        rows = [r.asDict(recursive=True) for r in df.limit(200).collect()]
        told[name] = rows[0] if len(rows) == 1 else rows
    return json.dumps(told, ensure_ascii=False, default=str)


def not_expired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)
