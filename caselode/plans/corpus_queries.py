"""Corpus build, profile and sampling queries with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caselode.functions import text as T
from caselode.operators import corpus
from caselode.operators.skew import spread
from caselode.plans import nested_queries
from caselode.sources.tables import table

WS = r"[\s\x{85}\p{Z}]"


def _clean_sql(c: str) -> str:
    """The layout cleaning in DuckDB."""
    steps = (
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "), (r"\[\*\*.*?\*\*\]", "[REDACTED]"), (r"\bXXXX+\b", "[REDACTED]"),
        (r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", r"\1\2"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"),
        (rf"^{WS}+|{WS}+$", ""),
    )
    for pattern, by in steps:
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return c


def _words_sql(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> ''))"


def corpus_documents(spark: SparkSession, d: str) -> DataFrame:
    doc = T.fallback(F.col("full_note"), F.col("note"))
    return table(spark, d, "augmented_notes_30k").select(
        "line_no",
        F.concat(F.lit("acn-"), F.coalesce("idx", F.col("line_no").cast("string"))).alias("case_id"),
        F.length(doc).cast("long").alias("n_chars"),
        F.sha2(doc, 256).alias("text_hash"),
        T.prefix(doc, 300).alias("snippet"),
    )


CORPUS_DOCUMENTS = """
SELECT line_no, 'acn-' || coalesce(idx, CAST(line_no AS VARCHAR)) AS case_id, length(doc) AS n_chars,
       sha256(doc) AS text_hash, substring(doc, 1, 300) AS snippet
FROM (SELECT *, coalesce(nullif(full_note, ''), note) AS doc FROM augmented_notes_30k)
"""


def corpus_dedup(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "augmented_notes_30k").select("line_no", "note")
    return corpus.keep_first(raw, T.text_hash(F.col("note")), "line_no").select("line_no", T.text_hash(F.col("note")).alias("note_hash"))


CORPUS_DEDUP = """
SELECT min(line_no) AS line_no, note_hash
FROM (SELECT line_no, sha256(coalesce(note, '')) AS note_hash FROM augmented_notes_30k) GROUP BY note_hash
"""


def corpus_clean_text(spark: SparkSession, d: str) -> DataFrame:
    c = T.clean_layout(T.fallback(F.col("full_note"), F.col("note")))
    return table(spark, d, "augmented_notes_30k").select("line_no", F.md5(c).alias("text_md5"), F.length(c).cast("long").alias("n_chars"))


CORPUS_CLEAN = f"""
SELECT line_no, md5(c) AS text_md5, length(c) AS n_chars
FROM (SELECT line_no, {_clean_sql("coalesce(nullif(full_note, ''), note)")} AS c FROM augmented_notes_30k)
"""


def corpus_nfkc_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "augmented_notes_30k").select("line_no", T.clean_text(T.fallback(F.col("full_note"), F.col("note"))).alias("text"))


def corpus_cases(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "augmented_notes_30k").select("line_no", "idx", "note", "full_note", "summary")
    return corpus.build_cases(spread(raw))


def corpus_cases_layout(spark: SparkSession, d: str) -> DataFrame:
    """Clean cases without the compatibility composition; those whose summary needed no repair."""
    raw = table(spark, d, "augmented_notes_30k").select("line_no", "idx", "note", "full_note", "summary")
    cases = corpus.build_cases(spread(raw), with_nfkc=False).where("summary_status <> 'repaired'")
    return cases.select("line_no", "case_id", F.md5("document").alias("document"), "summary_status", "sex", F.col("age").cast("long").alias("age"), "age_band", "outcome_class", F.array_join("quality_flags", ",").alias("quality_flags"))


def corpus_min_length(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "augmented_notes_30k").select("line_no", "note", "full_note")
    first = corpus.keep_first(raw, T.text_hash(F.col("note")), "line_no")
    words = T.word_count(T.clean_layout(T.fallback(F.col("full_note"), F.col("note"))))
    return first.select("line_no", words.alias("words")).where("words >= 60")


CORPUS_MIN_LENGTH = f"""
WITH first AS (SELECT min(line_no) AS line_no FROM augmented_notes_30k GROUP BY sha256(coalesce(note, ''))),
counted AS (SELECT line_no, {_words_sql(_clean_sql("coalesce(nullif(full_note, ''), note)"))} AS words
            FROM augmented_notes_30k JOIN first USING (line_no))
SELECT line_no, words FROM counted WHERE words >= 60
"""


def _cases_sql(summaries: str) -> str:
    """``summaries`` ends in a CTE docs (line_no, j) of the well-formed summaries."""
    joined = "coalesce(discharge, '') || ' ' || substring(document, CAST(floor(length(document) * 0.85) AS INT) + 1)"
    return rf"""{summaries}, first AS (SELECT min(line_no) AS line_no FROM augmented_notes_30k GROUP BY sha256(coalesce(note, ''))),
texts AS (SELECT line_no, 'acn-' || coalesce(idx, CAST(line_no AS VARCHAR)) AS case_id, coalesce(summary, '') AS s, {_clean_sql("coalesce(nullif(full_note, ''), note)")} AS document FROM augmented_notes_30k JOIN first USING (line_no)),
ends AS (SELECT line_no, string_agg(e.value ->> '$', ' ') AS discharge FROM docs, json_each(j, '$.discharge') e WHERE json_type(j, '$.discharge') = 'OBJECT' GROUP BY line_no),
rows AS (SELECT t.*, d.j, d.j ->> '$."patient information".sex' AS sex_text, lower(trim(d.j ->> '$."patient information".age')) AS age_text, discharge, {joined} AS tail
  FROM texts t LEFT JOIN docs d USING (line_no) LEFT JOIN ends USING (line_no)
  WHERE {_words_sql("document")} >= 60 AND (d.j IS NOT NULL OR NOT contains(s, '{{') OR (json_valid(s) AND NOT regexp_matches(s, ',\s*[}}\]]')))),
aged AS (SELECT *, CASE WHEN age_text NOT IN {T.EMPTY_WHEN_CLEANING} AND regexp_extract(age_text, '{T.AGE}', 1) <> '' THEN
  CASE WHEN regexp_extract(age_text, '{T.AGE}', 2) IN ('month', 'week', 'day') THEN 0 ELSE CAST(regexp_extract(age_text, '{T.AGE}', 1) AS BIGINT) END END AS years FROM rows),
known AS (SELECT *, CASE WHEN years BETWEEN 0 AND 120 THEN years END AS age FROM aged)
SELECT line_no, case_id, md5(document) AS document, CASE WHEN j IS NULL THEN 'failed' ELSE 'ok' END AS summary_status, {_SEX_SQL.format("sex_text")} AS sex, age,
  CASE WHEN age IS NULL THEN 'unknown' ELSE (age // 10 * 10)::VARCHAR || '-' || (age // 10 * 10 + 9)::VARCHAR END AS age_band,
  CASE WHEN regexp_matches(tail, '{T.DECEASED}') THEN 'deceased' WHEN regexp_matches(tail, '{T.DETERIORATED}') THEN 'deteriorated' WHEN regexp_matches(tail, '{T.IMPROVED}') THEN 'improved' ELSE 'unknown' END AS outcome_class,
  CASE WHEN j IS NULL THEN 'no_structured_summary' ELSE '' END AS quality_flags FROM known
"""


def corpus_point_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases_clean").select("row_no", T.uuid5_dns(F.col("case_id")).alias("point_id"))


def corpus_note_checks(spark: SparkSession, d: str) -> DataFrame:
    note = F.col("note")
    return table(spark, d, "augmented_notes_30k").groupBy("feed").agg(
        F.count("*").alias("notes"),
        F.count_if(T.word_count(note) < 50).alias("short_notes"),
        F.count_if(T.unusual_unicode(note)).alias("unusual_unicode"),
        F.count_if(T.is_empty_value(F.col("full_note"))).alias("empty_full_notes"),
        F.count_if(F.col("loaded_at") > F.col("written_at") + F.expr("interval 2 days")).alias("late_rows"),
    )


CORPUS_NOTE_CHECKS = f"""
SELECT feed, count(*) AS notes,
       count(*) FILTER ({_words_sql("note")} < 50) AS short_notes,
       count(*) FILTER (regexp_matches(substring(note, 1, 2000), '[\\x{{3000}}-\\x{{10FFFF}}]')) AS unusual_unicode,
       count(*) FILTER (full_note IS NULL OR lower(regexp_replace(full_note, '^{WS}+|{WS}+$', '', 'g')) IN {T.EMPTY_VALUES}) AS empty_full_notes,
       count(*) FILTER (loaded_at > written_at + INTERVAL 2 DAY) AS late_rows
FROM augmented_notes_30k GROUP BY feed
"""


def corpus_duplicates(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "augmented_notes_30k").groupBy(T.text_hash(F.col("note")).alias("h")).agg(F.count("*").alias("c"))
    return by.agg(F.sum("c").alias("notes"), F.count("*").alias("distinct_notes"), F.sum(F.col("c") - 1).alias("duplicates"))


CORPUS_DUPLICATES = """
SELECT CAST(sum(c) AS BIGINT) AS notes, count(*) AS distinct_notes, CAST(sum(c - 1) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS c FROM augmented_notes_30k GROUP BY sha256(coalesce(note, '')))
"""


def summary_attributes(spark: SparkSession, d: str) -> DataFrame:
    s = F.try_parse_json("summary")
    cases = table(spark, d, "cases_clean").select("row_no", s.alias("s"))
    sex = F.expr("""try_variant_get(s, '$["patient information"].sex', 'string')""")
    age = T.normalize_age(F.expr("""try_variant_get(s, '$["patient information"].age', 'string')"""))
    return cases.select("row_no", T.normalize_sex(sex).alias("sex"), age.cast("long").alias("age"), T.age_band(age).alias("age_band"))


_SEX_SQL = "CASE WHEN lower(trim({0})) IN %s THEN 'male' WHEN lower(trim({0})) IN %s THEN 'female' ELSE 'unknown' END" % (
    T.SEX_WORDS["male"],
    T.SEX_WORDS["female"],
)
SUMMARY_ATTRIBUTES = f"""
WITH got AS (
  SELECT row_no, json_extract_string(summary, '$."patient information".sex') AS sex_text,
         lower(trim(json_extract_string(summary, '$."patient information".age'))) AS age_text FROM cases_clean),
num AS (
  SELECT *, regexp_extract(age_text, '{T.AGE}', 1) AS number, regexp_extract(age_text, '{T.AGE}', 2) AS unit FROM got),
aged AS (
  SELECT row_no, sex_text, CASE WHEN age_text NOT IN {T.EMPTY_WHEN_CLEANING} AND number <> '' AND
         (CASE WHEN unit IN ('month', 'week', 'day') THEN 0 ELSE TRY_CAST(number AS BIGINT) END) BETWEEN 0 AND 120
         THEN (CASE WHEN unit IN ('month', 'week', 'day') THEN 0 ELSE TRY_CAST(number AS BIGINT) END) END AS age FROM num)
SELECT row_no, {_SEX_SQL.format("sex_text")} AS sex, age,
       CASE WHEN age IS NULL THEN 'unknown' ELSE (age // 10 * 10)::VARCHAR || '-' || (age // 10 * 10 + 9)::VARCHAR END AS age_band
FROM aged
"""


def outcome_class(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("document")
    return table(spark, d, "cases_clean").select("row_no", T.outcome_class(doc, F.lit(None).cast("string")).alias("outcome"))


OUTCOME_CLASS = f"""
SELECT row_no, CASE WHEN regexp_matches(tail, '{T.DECEASED}') THEN 'deceased'
  WHEN regexp_matches(tail, '{T.DETERIORATED}') THEN 'deteriorated'
  WHEN regexp_matches(tail, '{T.IMPROVED}') THEN 'improved' ELSE 'unknown' END AS outcome
FROM (SELECT row_no, coalesce(substring(document, CAST(floor(length(document) * 0.85) AS INT) + 1), '') AS tail FROM cases_clean)
"""


def profile_distribution(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "augmented_notes_30k")
    both = raw.select(F.explode(F.create_map(F.lit("note"), F.col("note"), F.lit("full_note"), F.col("full_note"))).alias("field", "text"))
    return corpus.index_quantiles(both.where("text is not null"), T.word_count(F.col("text")), ["field"])


PROFILE_DISTRIBUTION = f"""
WITH v AS (
  SELECT 'note' AS field, {_words_sql("note")} AS v FROM augmented_notes_30k WHERE note IS NOT NULL
  UNION ALL SELECT 'full_note', {_words_sql("full_note")} FROM augmented_notes_30k WHERE full_note IS NOT NULL),
s AS (SELECT field, list_sort(list(v)) AS l, count(*) AS n, avg(v) AS m FROM v GROUP BY field)
SELECT field, n, l[1] AS min, l[n // 4 + 1] AS p25, CAST(floor((l[(n - 1) // 2 + 1] + l[n // 2 + 1]) / 2) AS BIGINT) AS median,
       l[3 * n // 4 + 1] AS p75, l[CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1] AS p95, l[n] AS max, round(m, 1) AS mean FROM s
"""


def profile_field_counts(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "cases_clean")
    fields = ["sex", "outcome_class", "summary_status", "age_band", "source"]
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return cases.select(F.inline(entries)).groupBy("field", "value").agg(F.count("*").alias("cases"))


PROFILE_FIELD_COUNTS = " UNION ALL ".join(
    f"SELECT '{f}' AS field, {f} AS value, count(*) AS cases FROM cases_clean GROUP BY {f}"
    for f in ("sex", "outcome_class", "summary_status", "age_band", "source")
)


def profile_top_values(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "search_log").where("top_case_id is not null").groupBy("top_case_id").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "top_case_id").limit(10)
    )


PROFILE_TOP_VALUES = """
SELECT top_case_id, count(*) AS n FROM search_log WHERE top_case_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, top_case_id LIMIT 10
"""


def profile_section_coverage(spark: SparkSession, d: str) -> DataFrame:
    return corpus.section_coverage(table(spark, d, "cases_clean"), "summary")


PROFILE_SECTION_COVERAGE = f"""
WITH p AS (SELECT row_no, CAST(summary AS JSON) AS s FROM cases_clean WHERE json_type(summary) = 'OBJECT'),
k AS (SELECT row_no, unnest(json_keys(s)) AS section, s FROM p),
f AS (SELECT section, lower(trim(coalesce(json_extract_string(s, '$."' || section || '"'), ''))) AS v FROM k)
SELECT section, count(*) AS filled, round(100.0 * count(*) / (SELECT count(*) FROM p), 1) AS percent
FROM f WHERE v NOT IN {(*T.EMPTY_VALUES, "[]", "{}")} GROUP BY section
"""


def quality_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases_clean").select(F.explode_outer("quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("cases"))


QUALITY_FLAG_COUNTS = """
SELECT flag, count(*) AS cases FROM (
  SELECT unnest(CASE WHEN len(quality_flags) > 0 THEN quality_flags ELSE [NULL] END) AS flag FROM cases_clean) GROUP BY flag
"""


def _latest_cases(spark: SparkSession, d: str) -> DataFrame:
    return corpus.latest_wins(table(spark, d, "cases_clean"), ["case_id"], ["built_at", "row_no"])


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return _latest_cases(spark, d).select("case_id", "row_no", "sex", "age", "outcome_class", "built_at")


UPSERT_LATEST = """
SELECT case_id, row_no, sex, age, outcome_class, built_at FROM cases_clean
QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY built_at DESC, row_no DESC) = 1
"""


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "cases_clean").select("row_no", "outcome_class", "age_band", "sex")
    return corpus.stratified_sample(cases, ["outcome_class", "age_band", "sex"], "row_no", 300)


def gold_sample(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "cases_clean").select("row_no", "outcome_class")
    return corpus.stratified_sample(cases, ["outcome_class"], "row_no", 100, at_least_one=True)


def _sample_sql(strata: str, size: int, least: str) -> str:
    return f"""
WITH r AS (SELECT row_no, {strata}, sha256(row_no::VARCHAR || '-42') AS h,
                  count(*) OVER (PARTITION BY {strata}) AS n, count(*) OVER () AS total FROM cases_clean),
q AS (SELECT *, greatest({least}, least(CAST(round_even({size} * n / total::DOUBLE, 0) AS BIGINT), n)) AS quota,
             row_number() OVER (PARTITION BY {strata} ORDER BY h, row_no) AS rn FROM r)
SELECT row_no, {strata} FROM q ORDER BY rn > quota, h, row_no LIMIT {size}
"""


QUERIES = {
    f.__name__: f
    for f in (
        corpus_documents, corpus_dedup, corpus_clean_text, corpus_nfkc_clean, corpus_cases, corpus_cases_layout, corpus_min_length, corpus_point_id,
        corpus_note_checks, corpus_duplicates, summary_attributes, outcome_class, profile_distribution, profile_field_counts,
        profile_top_values, profile_section_coverage, quality_flag_counts, upsert_latest, stratified_sample, gold_sample,
    )
}
ORACLE = {
    "corpus_documents": CORPUS_DOCUMENTS,
    "corpus_dedup": CORPUS_DEDUP,
    "corpus_clean_text": CORPUS_CLEAN,
    "corpus_cases_layout": _cases_sql(nested_queries._TREE),
    "corpus_min_length": CORPUS_MIN_LENGTH,
    "corpus_point_id": """WITH h AS (SELECT row_no, sha1('\\x6B\\xA7\\xB8\\x10\\x9D\\xAD\\x11\\xD1\\x80\\xB4\\x00\\xC0\\x4F\\xD4\\x30\\xC8'::BLOB || encode(case_id)) AS h FROM cases_clean)
        SELECT row_no, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substring('89ab', CAST(('0x' || h[17:17])::BIGINT % 4 AS BIGINT) + 1, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM h""",
    "corpus_note_checks": CORPUS_NOTE_CHECKS,
    "corpus_duplicates": CORPUS_DUPLICATES,
    "summary_attributes": SUMMARY_ATTRIBUTES,
    "outcome_class": OUTCOME_CLASS,
    "profile_distribution": PROFILE_DISTRIBUTION,
    "profile_field_counts": PROFILE_FIELD_COUNTS,
    "profile_top_values": PROFILE_TOP_VALUES,
    "profile_section_coverage": PROFILE_SECTION_COVERAGE,
    "quality_flag_counts": QUALITY_FLAG_COUNTS,
    "upsert_latest": UPSERT_LATEST,
    "stratified_sample": _sample_sql("outcome_class, age_band, sex", 300, "0"),
    "gold_sample": _sample_sql("outcome_class", 100, "1"),
}
