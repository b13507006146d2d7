import json

import pytest
from pyspark.sql import functions as F

from caselode.config import configured
from caselode.sources import files
from caselode.sources.tables import verified_scan
from caselode.streaming import streams


def test_jsonl_and_documents(spark, tmp_path):
    path = tmp_path / "deep" / "raw.jsonl"
    path.parent.mkdir()
    path.write_text('{"note": "é", "idx": "1"}\n\n  \n{bad\n[1]\n{"note": null}\n', encoding="utf-8")
    rows, counts = files.read_jsonl(spark, str(path), "note string, idx string")
    assert [tuple(r) for r in rows.collect()] == [("é", "1"), (None, None)]
    assert tuple(counts.first()) == (4, 2)
    assert files.find_sources(spark, str(tmp_path), "*.jsonl")[0].endswith("deep/raw.jsonl")
    out = tmp_path / "out"
    files.write_jsonl(rows, str(out))
    assert [json.loads(x) for p in sorted(out.glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()][0] == {"note": "é", "idx": "1"}
    doc = tmp_path / "manifest.json"
    doc.write_text('{\n "num_cases": 3\n}')
    assert files.read_json_document(spark, str(doc)).first()["num_cases"] == 3


def test_append_and_upsert_can_be_repeated(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    more = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    path = str(tmp_path / "append")
    for part in (df, df, more):
        files.append_missing(part, path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 1), ("c", 2)]
    path = str(tmp_path / "upsert")
    for part in (df, more, more, df):
        files.upsert(part, path, ["k"], ["v"])
    assert sorted(map(tuple, files.read_versioned(spark, path).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert verified_scan(spark, f"{path}/v=3", 3).count() == 3
    # a run cut short leaves a version without a marker: it does not count, and is written anew
    df.write.parquet(f"{path}/v=4")
    assert files.read_versioned(spark, path).count() == 3
    files.upsert(spark.createDataFrame([("d", 9)], "k string, v int"), path, ["k"], ["v"], version=4)
    files.upsert(spark.createDataFrame([("e", 9)], "k string, v int"), path, ["k"], ["v"], version=4)
    assert files.read_versioned(spark, path).count() == 4


def test_csv_and_delete(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1), (None, 2), ('q"x', None)], "k string, v int")
    path = str(tmp_path / "csv")
    files.write_csv(df, path)
    rows, counts = files.read_csv(spark, path, "k string, v int")
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr) and tuple(counts.first()) == (3, 0)
    (tmp_path / "bad.csv").write_text("k,v\nx,1\ny,word\n")
    rows, counts = files.read_csv(spark, str(tmp_path / "bad.csv"), "k string, v int")
    assert [tuple(r) for r in rows.collect()] == [("x", 1)] and tuple(counts.first()) == (2, 1)
    kept, gone = files.delete_where(df, F.col("v") > 1)
    assert kept.count() == 2 and [r["v"] for r in gone.collect()] == [2]


def test_configuration_and_sources(spark, tmp_path):
    got = configured({"caselode.alpha": "0.7", "caselode.k": "3", "other": "x"}, {"CASELODE_K": "9", "CASELODE_PROMPT_VERSION": "v2"})
    assert (got.alpha, got.k, got.prompt_version, got.beta) == (0.7, 3, "v2", 0.9)
    with pytest.raises(ValueError):
        configured({"caselode.depth": "deep"}, {})
    for name in ("a/sample.jsonl", "b/full.jsonl", "b/zero.jsonl"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}")
    assert files.first_source(spark, str(tmp_path), "*.jsonl", ("full", "sample")).endswith("b/full.jsonl")
    assert files.first_source(spark, str(tmp_path), "*.jsonl").endswith("a/sample.jsonl")
    assert files.first_source(spark, str(tmp_path), "*.csv") is None


def test_stored_tables_are_built_once_per_input(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("a")
    built = []
    make = lambda: built.append(1) or spark.range(len(built))
    assert [files.stored_table(spark, "once", [str(source)], make).count() for _ in range(2)] == [1, 1] and len(built) == 1
    source.write_text("more")
    assert files.stored_table(spark, "once", [str(source)], make).count() == 2


def test_report(spark):
    df = spark.createDataFrame([("x", 0.5), ("y", 0.7), ("z", None)], "mode string, ndcg double")
    assert json.loads(files.json_report(modes=df.orderBy("mode"), all=df.agg(F.count("*").alias("n")))) == {"modes": [{"mode": "x", "ndcg": 0.5}, {"mode": "y", "ndcg": 0.7}, {"mode": "z", "ndcg": None}], "all": {"n": 3}}
    assert files.markdown_table(df.orderBy("mode"), ["ndcg"]).splitlines()[3] == "| y | **0.7** |"


def test_streams_equal_batch(spark, tmp_path):
    times = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 777)
    events = spark.range(200).select(F.col("id").alias("event_id"), times.alias("ts"), (F.col("id") % 7).alias("user_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("event_type"), F.lit(1.0).alias("value"))
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = streams.run_windows(spark, str(tmp_path))
    want = events.groupBy(F.date_trunc("HOUR", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.select("hour", "event_type", "n").collect())) == sorted(map(tuple, want.collect()))
    cases = spark.range(50).select((F.col("id") % 20).cast("string").alias("case_id"), F.col("id").alias("row_no"), F.lit("f").alias("sex"), F.lit(1).alias("age"), F.lit("x").alias("outcome_class"), times.alias("built_at"))
    cases.repartition(4).write.parquet(str(tmp_path / "cases_clean.parquet"))
    got = {r["case_id"]: r["row_no"] for r in streams.run_upsert(spark, str(tmp_path)).collect()}
    assert got == {str(k): max(i for i in range(50) if i % 20 == k) for k in range(20)}


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    """Three files in three runs, with late and repeated rows, equal the batch over all of them."""
    times = F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id") * 5000)  # later files hold earlier rows
    place = {name: str(tmp_path / f"place-{name}") for name in ("windows", "dedup", "upsert", "closed")}
    for run in range(3):
        ids = spark.range(run * 40, run * 40 + 60)
        ids.select(F.col("id").alias("log_id"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("c"), F.col("id") % 50)).alias("correlation_id"), times.alias("logged_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "search_log.parquet"))
        ids.select(F.col("id").alias("event_id"), times.alias("ts"), F.concat(F.lit("t"), F.col("id") % 3).alias("event_type")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        ids.select((F.col("id") % 20).cast("string").alias("case_id"), F.col("id").alias("row_no"), F.lit("f").alias("sex"), F.lit(run).alias("age"), F.lit("x").alias("outcome_class"), times.alias("built_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "cases_clean.parquet"))
        windows = streams.run_windows(spark, str(tmp_path), place["windows"])
        once = streams.run_dedup(spark, str(tmp_path), place["dedup"])
        latest = streams.run_upsert(spark, str(tmp_path), place["upsert"])
        closed = streams.run_closed_windows(spark, str(tmp_path), place["closed"])
    for name in ("events", "search_log", "cases_clean"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).createOrReplaceTempView(f"all_{name}")
    same = lambda df, sql: sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, spark.sql(sql).collect()), key=repr)
    assert same(windows.select("hour", "event_type", "n"), "SELECT date_trunc('HOUR', ts), event_type, count(*) FROM all_events GROUP BY 1, 2")
    assert same(once, "SELECT correlation_id, min(log_id) FROM all_search_log WHERE correlation_id IS NOT NULL GROUP BY 1 UNION ALL SELECT DISTINCT NULL, log_id FROM all_search_log WHERE correlation_id IS NULL")
    assert same(latest.select("case_id", "row_no"), "SELECT case_id, max_by(row_no, struct(built_at, row_no)) FROM all_cases_clean GROUP BY 1")
    assert 0 < closed.count() <= windows.count()
