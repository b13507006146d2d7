"""Queries of the numbered problems tagged llm, with DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from caselode.llm import canonical, leakage, pii, proportions, quality, splitting, tokens
from caselode.operators.skew import spread
from caselode.sources.tables import table


def _sampled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return proportions.proportional_sample(table(spark, d, "cases_clean"), table(spark, d, "sample_targets"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1].where("short_by > 0").select("plan_id", "outcome_class")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1]


def p1_shortfalls(spark: SparkSession, d: str) -> DataFrame:
    """Every target row with what it needs, what there is and how much is missing; and whether the draw kept its floor."""
    report = _sampled(spark, d)[1]
    floor = F.least(F.coalesce("min_rows", F.lit(0)), "available")
    return report.select("plan_id", "outcome_class", "needed", "available", "short_by", (F.col("sampled") >= floor).alias("floor_kept"))


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[0]


_P1_NEED = """
WITH avail AS (
  SELECT lower(trim(outcome_class)) AS cls, count(DISTINCT case_id) AS available
  FROM cases_clean WHERE outcome_class IS NOT NULL GROUP BY 1),
need AS (
  SELECT plan_id, outcome_class, greatest(min_rows, CAST(round(target_share * sample_size) AS BIGINT)) AS needed,
         coalesce(available, 0) AS available
  FROM sample_targets t LEFT JOIN avail a ON a.cls = lower(trim(t.outcome_class)))
"""
P1_SQL = _P1_NEED + "SELECT plan_id, outcome_class FROM need WHERE available < needed"
P1_SHORTFALLS = _P1_NEED + "SELECT plan_id, outcome_class, needed, available, greatest(needed - available, 0) AS short_by, true AS floor_kept FROM need"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    notes = canonical.lookalike_pairs(spread(table(spark, d, "augmented_notes_30k").select("line_no", "note")), "line_no", "note")
    documents = canonical.lookalike_pairs(spread(table(spark, d, "cases_clean").select("row_no", "document")), "row_no", "document")
    return notes.select(F.lit("note").alias("field_name"), "key_a", "key_b").unionByName(
        documents.select(F.lit("document").alias("field_name"), "key_a", "key_b")
    )


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every note and document that has a look-alike, with its class: rows of one class look the same."""
    notes = canonical.lookalike_classes(spread(table(spark, d, "augmented_notes_30k").select("line_no", "note")), "line_no", "note")
    documents = canonical.lookalike_classes(spread(table(spark, d, "cases_clean").select("row_no", "document")), "row_no", "document")
    both = notes.withColumn("field_name", F.lit("note")).unionByName(documents.withColumn("field_name", F.lit("document")))
    return both.select("field_name", F.hex("class_id").alias("class_id"), F.hex("form").alias("form"), F.col("key").alias("row_key"))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """The one form of every note and document, as text."""
    notes = table(spark, d, "augmented_notes_30k").select(F.lit("note").alias("field_name"), F.col("line_no").alias("row_key"), F.col("note").alias("text"))
    documents = table(spark, d, "cases_clean").select(F.lit("document").alias("field_name"), F.col("row_no").alias("row_key"), F.col("document").alias("text"))
    return notes.unionByName(documents).select("field_name", "row_key", canonical.canonical_text(F.col("text")).alias("text"))


def _pieces(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    return splitting.split_texts(spread(table(spark, d, "cases_clean").select("row_no", "document")), "row_no", "document", table(spark, d, "split_limits"), with_text)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, False).where("piece_no = 1").select("limit_id", "row_no")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, True)


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """What holds of the pieces of every cut document: sizes within the limit, pieces equal to their stretch of the text,
    each further on than the one before, and nothing but blanks between, before and behind them."""
    texts = table(spark, d, "cases_clean").select("row_no", "document")
    limits = F.broadcast(table(spark, d, "split_limits").select("limit_id", "max_size").limit(splitting.MAX_LIMITS))
    rows = p3_pieces(spark, d).join(texts, "row_no").join(limits, "limit_id")
    by = Window.partitionBy("row_no", "limit_id").orderBy("piece_no")  # the pieces of one text
    before, end = F.coalesce(F.lag("end_at").over(by), F.lit(0)), F.lag("start_at").over(by)
    blank = lambda start, stop: ~F.coalesce(F.substring(F.col("document"), start + 1, F.greatest(stop - start, F.lit(0))), F.lit("")).rlike(r"[^ \t\r\n]")
    last = F.lead("piece_no").over(by).isNull()
    told = rows.select(
        "row_no", "limit_id", (F.col("size") <= F.col("max_size")).alias("fits"),
        (F.col("piece") == F.substring(F.col("document"), F.col("start_at") + 1, F.col("end_at") - F.col("start_at"))).alias("same"),
        F.coalesce(F.col("start_at") > end, F.lit(True)).alias("goes_on"),
        (blank(before, F.col("start_at")) & (~last | blank(F.col("end_at"), F.length("document")))).alias("whole"),
    )
    return told.groupBy("row_no", "limit_id").agg(*[F.min(c).alias(c) for c in ("fits", "same", "goes_on", "whole")])


P3_SQL = r"""
SELECT limit_id, row_no FROM cases_clean, split_limits
WHERE CASE unit WHEN 'chars' THEN length(document) WHEN 'bytes' THEN strlen(document)
      ELSE len(regexp_extract_all(document, '[^ \t\r\n]+')) END > max_size
"""


def _private_texts(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, float]]:
    documents = spread(table(spark, d, "cases_clean").select(F.lit("document").alias("field_name"), F.col("row_no").alias("row_key"), F.col("document").alias("text")))
    talks = spread(table(spark, d, "augmented_notes_30k").select(F.lit("conversation").alias("field_name"), F.col("line_no").alias("row_key"), F.col("conversation").alias("text")))
    return documents.unionByName(talks), pii.fit([documents, talks])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    texts, weights = _private_texts(spark, d)
    return pii.find_mentions(texts, weights).select("field_name", "row_key", "pii_kind", "start_at")


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    texts, weights = _private_texts(spark, d)
    return pii.redacted(texts, weights)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    encode = tokens.encoder("byte_bpe_50k")
    return _documents(spark, d).select("doc_id", encode(F.col("text")).alias("ids"))


def _alignments(spark: SparkSession, d: str, edited: bool = False) -> DataFrame:
    return leakage.leak_alignments(_documents(spark, d), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text", edited)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _alignments(spark, d).where(F.col("longest_run") >= leakage.WINDOW).select("doc_id", "item_id")


def p7_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Also edited and paraphrased copies: at least half of the item's perfect score."""
    return _alignments(spark, d, edited=True).where((F.col("longest_run") >= leakage.WINDOW) | (F.col("share") >= 0.5))


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.prose_report(
        _documents(spark, d), "doc_id", "text", table(spark, d, "common_words"), table(spark, d, "form_labels")
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_stats(spark, d).where("not is_prose").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_shortfalls, p1_sample, p2_found, p2_classes, p2_forms, p3_found, p3_pieces, p3_checks, p4_found, p4_redacted, p6_ids, p7_found, p7_alignments, p8_found, p8_stats)}
ORACLE = {"p1_found": P1_SQL, "p1_shortfalls": P1_SHORTFALLS, "p3_found": P3_SQL, "p3_checks": P3_SQL.replace("SELECT limit_id, row_no", "SELECT limit_id, row_no, true AS fits, true AS same, true AS goes_on, true AS whole")}
