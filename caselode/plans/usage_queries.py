"""Usage, negation, explanation and table queries with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from caselode.functions import json_repair, text as T
from caselode.operators import corpus, explain, filters, fusion, negation, nested, usage
from caselode.operators.filters import SearchFilters
from caselode.plans import nested_queries as N, retrieval_queries as R
from caselode.sources import files
from caselode.sources.tables import table


# ---- search log

def log_dedup(spark: SparkSession, d: str) -> DataFrame:
    return usage.distinct_requests(table(spark, d, "search_log")).select("log_id", "correlation_id", "query_id", "k")


def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    log = usage.distinct_requests(table(spark, d, "search_log"))
    return log.groupBy(F.date_format("requested_at", "yyyy-MM-dd").alias("day"), "profile").agg(
        F.count("*").alias("requests"), F.count_if(F.col("top_case_id").isNull()).alias("empty"), F.countDistinct("query_id").alias("queries")
    )


def usage_rolling(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "search_log").groupBy(F.to_date("requested_at").alias("day")).agg(F.count("*").alias("requests"))
    return usage.rolling_mean(daily, "day", "requests", 7).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return corpus.index_quantiles(table(spark, d, "search_log"), F.round("took_ms").cast("long"), ["profile"])


def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    log = usage.distinct_requests(table(spark, d, "search_log"))
    keys = ["query_id", "profile", "k", "sex", "outcome_class", "age_min"]
    hits = usage.cache_hits(log, keys, "requested_at", "log_id", 3600)
    return hits.agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"))


def served_version(spark: SparkSession, d: str) -> DataFrame:
    """The version of its top case that each logged search could have served."""
    log = table(spark, d, "search_log").where("top_case_id is not null").withColumnRenamed("top_case_id", "case_id")
    return usage.as_of(log, table(spark, d, "cases_clean"), "case_id", "requested_at", "built_at", "log_id", "row_no")


def top_case_share(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "search_log").where("top_case_id is not null")
    counts = log.groupBy("query_id", "top_case_id").agg(F.count("*").alias("n"), F.max("top_score").alias("best"))
    top = counts.groupBy("query_id").agg(F.max_by(F.struct("top_case_id", "n", "best"), F.struct("n", F.col("best"), "top_case_id")).alias("t"), F.sum("n").alias("total"))
    return top.select("query_id", "t.top_case_id", "t.n", F.round(F.col("t.n") / F.col("total"), 4).alias("share"))


def outcome_cube(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "cases_clean").select("sex", F.lower(F.trim("outcome_class")).alias("outcome"), "age")
    return cases.cube("sex", "outcome").agg(F.count("*").alias("cases"), F.round(F.avg("age"), 4).alias("mean_age"), F.grouping_id().cast("long").alias("level"))


def outcome_pivot(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "cases_clean").select("age_band", F.lower(F.trim("outcome_class")).alias("outcome"))
    named = ["improved", "deteriorated", "deceased", "unknown"]
    return cases.groupBy("age_band").pivot("outcome", named).agg(F.count(F.lit(1))).select("age_band", *[F.coalesce(c, F.lit(0)).alias(c) for c in named])


def index_reconcile(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "cases_clean").where("case_id is not null").select("case_id").distinct().withColumn("a", F.lit(1))
    two = table(spark, d, "documents").where("case_id is not null").groupBy("case_id").agg(F.count("*").alias("documents"))
    where = F.when(F.col("a").isNull(), "no_case").when(F.col("documents").isNull(), "no_document").otherwise("both")
    return one.join(two, "case_id", "full_outer").groupBy(where.alias("found")).agg(F.count("*").alias("cases"), F.sum(F.coalesce("documents", F.lit(0))).alias("documents"))


def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Cases no search has shown yet."""
    shown = table(spark, d, "search_log").where("top_case_id is not null").select(F.col("top_case_id").alias("case_id")).distinct()
    return table(spark, d, "cases_clean").where("case_id is not null").select("case_id").distinct().join(shown, "case_id", "left_anti")


def docs_semi_join(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "gold_queries").select(F.explode("relevant_case_ids").alias("case_id"))
    return table(spark, d, "cases_clean").join(wanted, "case_id", "left_semi").select("row_no", "case_id", F.substring("document", 1, 1600).alias("text"))


def case_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Requested cases in request order, the latest version of each; unknown ids are left out."""
    wanted = table(spark, d, "gold_queries").select("query_id", F.posexplode("relevant_case_ids").alias("position", "case_id"))
    return wanted.join(R.latest_cases(spark, d), "case_id").select("query_id", "position", "case_id", "row_no", F.length("document").cast("long").alias("n_chars"))


def snippet_left_join(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "label")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.substring("text", 1, 300).alias("snippet"))
    return vectors.join(docs, "vec_id", "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))


def group_by_case(spark: SparkSession, d: str) -> DataFrame:
    """Per case its longest document and the number of its documents by section."""
    docs = table(spark, d, "documents").where("case_id is not null and text is not null").withColumn("n", F.length("text").cast("long"))
    return docs.groupBy("case_id").agg(
        F.max_by("doc_id", F.struct("n", "doc_id")).alias("best_doc"), F.max("n").alias("n_chars"), F.countDistinct("note_section").alias("sections")
    )


def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Composite vector per label: mean of each component."""
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return parts.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


def source_late_rows(spark: SparkSession, d: str) -> DataFrame:
    lag = F.datediff("loaded_at", "written_at")
    docs = table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if(lag >= 7).alias("late"), F.max(lag).cast("long").alias("worst_days"), F.count_if(F.col("n_chars") != F.length("text")).alias("stale_lengths")
    )
    return docs


def lab_trends(spark: SparkSession, d: str) -> DataFrame:
    labs = usage.lab_values(table(spark, d, "cases_clean").where("document is not null"), "row_no", "document")
    return labs.groupBy("analyte", "unit").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 4).alias("mean"))


def lab_months(spark: SparkSession, d: str) -> DataFrame:
    """Per analyte, unit and month the mean of its values, and the change to the month before."""
    cases = table(spark, d, "cases_clean").where("document is not null")
    labs = usage.lab_values(cases, "row_no", "document").join(cases.select("row_no", F.date_format("built_at", "yyyy-MM").alias("month")), "row_no")
    months = labs.groupBy("analyte", "unit", "month").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    before = F.lag("mean").over(Window.partitionBy("analyte", "unit").orderBy("month"))  # a row a month
    return months.select("analyte", "unit", "month", "n", F.round("mean", 4).alias("mean"), F.round(F.col("mean") - before, 4).alias("change"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("HOUR", F.col("ts").cast("timestamp")).alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return usage.sessions(table(spark, d, "events"), "user_id", "ts")


def budget_packing(spark: SparkSession, d: str) -> DataFrame:
    """Of the fused list of each query, what fits into 3000 words in order of rank."""
    words = R.latest_cases(spark, d).select("case_id", T.word_count(F.col("document")).alias("words"))
    ranked = R._pool(spark, d, 30).join(words, "case_id").where("words is not null")
    return usage.within_budget(ranked, F.col("words"), 3000).select("query_id", "case_id", "rank", "spent")


def mean_latency(spark: SparkSession, d: str) -> DataFrame:
    log = usage.distinct_requests(table(spark, d, "search_log"))
    return log.groupBy("profile").agg(F.count("took_ms").alias("requests"), F.round(F.avg("took_ms"), 1).alias("mean_ms"))


def query_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Which texts the rule for generated queries keeps: 8..45 words, not the model talking about itself."""
    bare = F.regexp_replace(T.strip(F.regexp_replace("text", r'^[\s"]+|[\s"]+$', "")), r"[\s\p{Z}\x{85}]+", " ")
    words = F.size(F.split(bare, " ")).cast("long")
    own = F.lower(bare).rlike(r"^(?:i |sorry|here)")
    told = table(spark, d, "documents").where("text is not null")
    return told.select("lang", (words.between(8, 45) & ~own).alias("accepted")).groupBy("lang", "accepted").agg(F.count("*").alias("texts"))


def index_health(spark: SparkSession, d: str) -> DataFrame:
    """Points, versions to drop, and searches per status: one row."""
    cases = table(spark, d, "cases_clean").agg(F.countDistinct("case_id").alias("points"), (F.count("case_id") - F.countDistinct("case_id")).alias("old_versions"))
    log = table(spark, d, "search_log").agg(F.count("*").alias("searches"), F.count_if(F.col("top_case_id").isNull()).alias("empty_searches"))
    return cases.crossJoin(log).withColumn("status", F.when(F.col("points") > 0, "ok").otherwise("degraded"))  # one row each


def precision_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Share of searches whose top case is a relevant one, with the change to the month before."""
    gold = table(spark, d, "gold_queries").select("query_id", "relevant_case_ids")
    log = usage.distinct_requests(table(spark, d, "search_log")).where("top_case_id is not null").join(gold, "query_id")
    hit = F.array_contains("relevant_case_ids", F.col("top_case_id")).cast("int")
    monthly = log.groupBy(F.date_format("requested_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("searches"), F.sum(hit).alias("hits"))
    share = F.col("hits") / F.col("searches")
    return monthly.select("month", "searches", "hits", F.round(share - F.lag(share).over(Window.orderBy("month")), 6).alias("change"))  # a row a month


# ---- relational tables

def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("quantity"), F.sum(price).cast("double").alias("revenue"), F.count("*").alias("lines")
    )


def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))
    return (
        table(spark, d, "lineitem").select("l_orderkey", price.alias("price"))
        .join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
        .join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
        .join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
        .groupBy("n_name").agg(F.sum("price").cast("double").alias("revenue"))
    )


def top_orders(spark: SparkSession, d: str) -> DataFrame:
    """The three dearest orders of each segment."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return orders.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("c_mktsegment", "o_orderkey", "o_totalprice", "rank")


# ---- negation and explanations

def negated_scopes(spark: SparkSession, d: str) -> DataFrame:
    scopes = negation.native_scopes(F.col("document"))
    return table(spark, d, "cases_clean").where("document is not null").select("row_no", F.size(scopes).cast("long").alias("n"), F.md5(F.array_join(scopes, "|")).alias("scopes"))


def negated_spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases_clean").where("document is not null").select("row_no", F.inline(negation.negated_spans(F.col("document"))))


def negation_triggers(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower("document"), F.lit(negation._TRIGGER), F.lit(0))
    return table(spark, d, "cases_clean").select(F.explode(found).alias("trigger")).groupBy("trigger").agg(F.count("*").alias("n"))


def negation_parse_query(spark: SparkSession, d: str) -> DataFrame:
    """Terms every served search asserts and denies, by how often they were asked for."""
    log = usage.distinct_requests(table(spark, d, "search_log")).groupBy("query_id").agg(F.count("*").alias("asked"))
    p = negation.query_polarity(F.col("query"))
    told = table(spark, d, "gold_queries").select("query_id", p.alias("p"))
    return log.join(told, "query_id").select("query_id", "asked", "p.positive", "p.negative")


def document_polarity(spark: SparkSession, d: str) -> DataFrame:
    """Terms each case document asserts and denies, counted."""
    p = negation.query_polarity(F.col("document"))
    return table(spark, d, "cases_clean").select("row_no", p.alias("p")).select("row_no", F.size("p.positive").alias("asserted"), F.size("p.negative").alias("denied"))


def _profile(spark: SparkSession, d: str, thorough: bool) -> DataFrame:
    pool = R._pool(spark, d, 50 if thorough else 30)
    if thorough:
        blended = fusion.rerank_blend(pool, R._logits(spark, d), "case_id", depth=50)
        pool = blended.select("query_id", "case_id", F.col("blend").alias("score"), F.col("new_rank").alias("rank"))
    texts = R.latest_cases(spark, d).select("case_id", "document", F.substring("document", 1, 300).alias("snippet"), F.array("outcome_class").alias("quality_flags"))
    return negation.adjust(pool, table(spark, d, "gold_queries").select("query_id", "query"), texts, "case_id", 10)


def search_fast(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d, False)


def search_thorough(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d, True)


def match_labels(spark: SparkSession, d: str) -> DataFrame:
    top = R._pool(spark, d, 10)
    return top.groupBy(T.match_label(F.col("score")).alias("label")).agg(F.count("*").alias("hits"))


def explain_context(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "gold_queries").select("query_id", F.posexplode("relevant_case_ids").alias("position", "case_id"))
    return explain.context(wanted, R.latest_cases(spark, d)).select("query_id", F.md5("context").alias("context"), F.length("context").cast("long").alias("n_chars"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Explanations as a model would write them, one attempt per profile: the logged top cases with citations."""
    counts = table(spark, d, "search_log").where("top_case_id is not null").groupBy("query_id", "profile", "top_case_id").agg(F.count("*").alias("n"))
    five = F.row_number().over(Window.partitionBy("query_id", "profile").orderBy(F.desc("n"), "top_case_id"))  # 1..5 cases are explained at once
    top = counts.withColumn("r", five).where("r <= 5")
    log = top.groupBy("query_id", "profile").agg(F.sort_array(F.collect_list("top_case_id")).alias("ids"))
    claim = lambda c: F.array(F.struct(F.lit("same course").alias("detail"), F.slice(F.array(c), 1, F.when(F.substring(F.md5(c), 1, 1).isin("0", "1", "2"), 0).otherwise(1)).alias("citations")))
    body = F.to_json(F.struct(F.transform("ids", lambda c: F.struct(c.alias("case_id"), claim(c).alias("differences"), F.lit("weak").alias("confidence"))).alias("explanations")))
    return log.select(F.col("query_id").alias("key"), F.when(F.col("profile") == "fast", 1).otherwise(2).alias("attempt"), F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("raw"))


def explain_validate(spark: SparkSession, d: str) -> DataFrame:
    top = R._branch(spark, d, "document", 100).select(F.col("query_id").alias("key"), "case_id")
    checked = explain.validate(_answers(spark, d), top)
    return checked.select("key", "attempt", F.array_join("problems", ",").alias("problems"))


def explain_fallback(spark: SparkSession, d: str) -> DataFrame:
    top = R._branch(spark, d, "document", 100).select(F.col("query_id").alias("key"), "case_id")
    keys = table(spark, d, "gold_queries").select(F.col("query_id").alias("key"))
    return explain.first_valid(explain.validate(_answers(spark, d), top), keys).select("key", "attempt", "degraded", "confidence")


def claim_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every claim of the answers with the score its case had in the search."""
    top = R._branch(spark, d, "document", 100).select(F.col("query_id").alias("key"), "case_id", "score")
    return explain.claim_scores(_answers(spark, d), top)


def audit_chain(spark: SparkSession, d: str) -> DataFrame:
    return usage.audit_chain(table(spark, d, "search_log"), "logged_at", ["log_id", "correlation_id", "query_id", "k"])


def filter_or_not(spark: SparkSession, d: str) -> DataFrame:
    """Women of 60 and over or anybody deceased, without those whose case has a quality flag."""
    wanted = filters.any_of(SearchFilters(sex="female", age_min=60), SearchFilters(outcome_class="deceased"))
    cases = table(spark, d, "cases_clean").where(filters.all_of(wanted, filters.none_of(F.size("quality_flags") > 0)))
    return cases.select("row_no", "sex", "age", "outcome_class")


def filter_version(spark: SparkSession, d: str) -> DataFrame:
    """Matches in the searched version of an index; here versions stand for the parity of the month a case was built in."""
    cases = R.latest_cases(spark, d).withColumn("embedding_version", F.when(F.month("built_at") % 2 == 0, "lex-v1").otherwise("lex-v0"))
    return SearchFilters(sex="female").apply(cases).groupBy("embedding_version", "age").agg(F.count("*").alias("cases"))


def soft_preferences(spark: SparkSession, d: str) -> DataFrame:
    """Thirty candidates of each query, those of women and of the old moved up, none left out."""
    known = R.latest_cases(spark, d).select("case_id", "sex", "age")
    pool = R._pool(spark, d, 30).join(known, "case_id")
    wishes = [(SearchFilters(sex="female"), 0.1), (SearchFilters(age_min=60), 0.05)]
    return filters.prefer(pool, wishes, "case_id").select("query_id", "case_id", "preferred", "new_rank")


def delete_by_filter(spark: SparkSession, d: str) -> DataFrame:
    """What is left and what goes when the deceased of a known age under 40 are deleted."""
    parts = files.delete_where(table(spark, d, "cases_clean"), SearchFilters(outcome_class="deceased", age_max=39).predicate())
    both = parts[0].withColumn("deleted", F.lit(False)).unionByName(parts[1].withColumn("deleted", F.lit(True)))
    return both.groupBy("deleted", "age_band").agg(F.count("*").alias("cases"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Cache key of every logged search whose top case would be explained."""
    log = table(spark, d, "search_log").where("top_case_id is not null").select("log_id", "query_id", F.array("top_case_id").alias("ids"))
    told = table(spark, d, "gold_queries").select("query_id", "query", "relevant_case_ids")
    key = explain.cache_key(F.col("query"), F.concat("ids", "relevant_case_ids"))
    return log.join(told, "query_id").select("log_id", key.alias("cache_key"))


def explain_prompt(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "gold_queries").select("query_id", F.posexplode("relevant_case_ids").alias("position", "case_id"))
    context = explain.context(wanted, R.latest_cases(spark, d))
    prompt = explain.prompt(F.col("query"), F.col("context"))
    return table(spark, d, "gold_queries").select("query_id", "query").join(context, "query_id").select("query_id", F.md5(prompt).alias("prompt"), F.length(prompt).cast("long").alias("n_chars"))


def citation_validity(spark: SparkSession, d: str) -> DataFrame:
    """Per gold query: cited top cases, and how many of them are among its hundred candidates."""
    cited = table(spark, d, "search_log").where("top_case_id is not null").select("query_id", F.col("top_case_id").alias("case_id")).distinct()
    valid = R._branch(spark, d, "document").select("query_id", "case_id", F.lit(1).alias("valid"))
    return cited.join(valid, ["query_id", "case_id"], "left").groupBy("query_id").agg(
        F.count("*").alias("cited"), F.count("valid").alias("valid"), F.round(F.count("valid") / F.count("*"), 4).alias("rate")
    )


def term_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Of each gold query and candidate: contradicted and shared denials."""
    told = table(spark, d, "gold_queries").select("query_id", negation.query_polarity(F.col("query")).alias("p"))
    texts = R.latest_cases(spark, d).select("case_id", F.substring("document", 1, 1600).alias("text"))
    pool = R._branch(spark, d, "document", 30).join(told, "query_id").join(texts, "case_id")
    return pool.withColumn("m", negation.polarity_matches(F.col("p.positive"), F.col("p.negative"), F.col("text"))).select("query_id", "case_id", "m.conflicts", "m.agreements")


def summary_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "augmented_notes_30k").select("line_no", json_repair.parsed(F.col("summary")).alias("p")).select("line_no", "p.status", "p.json")


def summary_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of every delivered summary: was it an object as it stands, after a repair, or not at all?"""
    return summary_status(spark, d).select("line_no", "status")


def summary_leaves(spark: SparkSession, d: str) -> DataFrame:
    """What pruning leaves of the well-formed summaries: each value, by its attribute."""
    kept = summary_status(spark, d).where("status = 'ok'").select("line_no", "json")
    rows = nested.node_rows(kept, "line_no", "json").select("line_no", F.explode("attributes").alias("attribute", "value"))
    return rows.groupBy("line_no", "attribute", "value").agg(F.count("*").alias("n"))


_LOG1 = "(SELECT * FROM search_log QUALIFY row_number() OVER (PARTITION BY correlation_id ORDER BY log_id) = 1 OR correlation_id IS NULL)"
_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))"
_END_SQL = r"[.;:,()\n]|\b(?:" + "|".join(negation.ENDINGS) + r")\b"


def _scopes_sql(name: str, source: str, key: str, text: str) -> str:
    """CTEs {name}_p (k, t) and {name}_sc (k, s, e): the scopes of each text by position."""
    total = lambda of: f"coalesce(list_sum(list_transform({of}, lambda x: length(x))), 0)"
    return rf"""
{name}_p AS (SELECT {key} AS k, {text} AS t FROM {source} WHERE {text} IS NOT NULL),
{name}_t AS (SELECT k, t, regexp_split_to_array(t, '(?i){negation._TRIGGER}') AS seg, regexp_extract_all(t, '(?i){negation._TRIGGER}') AS trig FROM {name}_p),
{name}_i AS (SELECT k, t, seg, trig, unnest(range(1, len(trig) + 1)) AS i FROM {name}_t),
{name}_a AS (SELECT k, t, CAST({total("seg[1:i]")} + {total("trig[1:i]")} AS BIGINT) AS s FROM {name}_i),
{name}_sc AS (SELECT * FROM (SELECT k, s, s + length(regexp_extract(substring(t, s + 1, 80), '(?is)^(.*?)(?:{_END_SQL}|$)', 1)) AS e FROM {name}_a) WHERE e > s)"""


def _polarity_sql(name: str) -> str:
    """CTE {name}_terms (k, denied, w) over the scopes of {name}."""
    none = ", ".join(f"'{w}'" for w in negation._NO_CONTENT)
    return rf"""
{name}_ws AS (SELECT k, regexp_extract_all(t, '{negation.WORD}') AS w, regexp_split_to_array(t, '{negation.WORD}') AS g FROM {name}_p),
{name}_wi AS (SELECT k, w, g, unnest(range(1, len(w) + 1)) AS i FROM {name}_ws),
{name}_wp AS (SELECT k, i, lower(w[i]) AS w, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS at FROM {name}_wi),
{name}_tok AS (SELECT k, i, w, length(w) > 2 AND w NOT IN ({none}) AS content, EXISTS (SELECT 1 FROM {name}_sc s WHERE s.k = p.k AND s.s <= p.at AND p.at < s.e) AS denied FROM {name}_wp p),
{name}_two AS (SELECT k, w || ' ' || lead(w) OVER o AS w, content AND lead(content) OVER o AS content, denied OR lead(denied) OVER o AS denied FROM {name}_tok WINDOW o AS (PARTITION BY k ORDER BY i)),
{name}_pr AS (SELECT DISTINCT k, denied, w FROM {name}_two WHERE content),
{name}_terms AS (SELECT * FROM {name}_pr UNION SELECT k, denied, w FROM {name}_tok t WHERE content AND length(w) >= 5
  AND NOT EXISTS (SELECT 1 FROM {name}_pr p WHERE p.k = t.k AND p.denied = t.denied AND contains(p.w, t.w)))"""


def _status_sql(pool: str) -> str:
    """CTE matched (query_id, case_id, conflicts, agreements) of a pool (query_id, case_id, text)."""
    return f"""
g AS (SELECT query_id, query FROM gold_queries), {_scopes_sql("q", "g", "query_id", "query")}, {_polarity_sql("q")},
few AS (SELECT DISTINCT case_id, text FROM {pool}), {_scopes_sql("c", "few", "case_id", "text")},
cut AS (SELECT DISTINCT p.case_id, t.w, string_split(lower(p.text), t.w) AS parts FROM {pool} p JOIN q_terms t ON t.k = p.query_id WHERE p.text IS NOT NULL),
occ AS (SELECT case_id, w, parts, unnest(range(1, len(parts))) AS j FROM cut),
pos AS (SELECT case_id, w, list_sum(list_transform(parts[1:j], lambda x: length(x))) + (j - 1) * length(w) AS at FROM occ),
st AS (SELECT case_id, w, bool_and(EXISTS (SELECT 1 FROM c_sc s WHERE s.k = p.case_id AND s.s <= p.at AND p.at < s.e)) AS negated FROM pos p GROUP BY ALL),
matched AS (SELECT p.query_id, p.case_id, count(*) FILTER ((negated AND NOT denied) OR (NOT negated AND denied)) AS conflicts, count(*) FILTER (negated AND denied) AS agreements
  FROM {pool} p LEFT JOIN q_terms t ON t.k = p.query_id LEFT JOIN st ON st.case_id = p.case_id AND st.w = t.w GROUP BY ALL)"""


def _adjusted_sql(ranked: str) -> str:
    """The re-ranked ten of each query from a list (query_id, case_id, score, rank)."""
    return f"""
texts AS (SELECT r.*, coalesce(nullif(substring(document, 1, 1600), ''), substring(document, 1, 300)) AS text, [outcome_class] AS flags FROM {ranked} r LEFT JOIN cases USING (case_id)),
{_status_sql("texts")},
adj AS (SELECT query_id, case_id, score, rank, CASE WHEN conflicts > 0 THEN round(score * power(0.75::DOUBLE, conflicts), 4) WHEN agreements > 0 THEN round(least(1.0::DOUBLE, score * 1.05::DOUBLE), 4) ELSE score END AS adjusted,
  CASE WHEN conflicts > 0 THEN list_append(flags, 'negation_conflict') ELSE flags END AS flags FROM texts JOIN matched USING (query_id, case_id))
SELECT query_id, case_id, score, adjusted, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, rank, case_id) AS new_rank, flags FROM adj QUALIFY new_rank <= 10"""


_ANSWERS_SQL = """
an AS (SELECT query_id AS key, CASE WHEN profile = 'fast' THEN 1 ELSE 2 END AS attempt, top_case_id AS case_id
  FROM (SELECT query_id, profile, top_case_id, count(*) AS n FROM search_log WHERE top_case_id IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY query_id, profile ORDER BY n DESC, top_case_id) <= 5),
claims AS (SELECT *, CASE WHEN substring(md5(case_id), 1, 1) IN ('0', '1', '2') THEN 0 ELSE 1 END AS cites FROM an)"""
_VALIDATED_SQL = f"""WITH {R._CASES_SQL}, {R._branch_sql('doc', 'document')}, {_ANSWERS_SQL},
    j AS (SELECT key, attempt, bool_or(doc.case_id IS NULL) AS unknown, bool_or(cites = 0) AS uncited, bool_or(cites = 1 AND doc.case_id IS NULL) AS bad
      FROM claims LEFT JOIN doc ON doc.query_id = key AND doc.case_id = claims.case_id GROUP BY key, attempt),
    v AS (SELECT key, attempt, concat_ws(',', CASE WHEN unknown THEN 'unknown_case' END, CASE WHEN uncited THEN 'uncited_claim' END, CASE WHEN bad THEN 'bad_citation' END) AS problems FROM j)"""
_CHAIN_SQL = """WITH RECURSIVE r AS (SELECT strftime(logged_at, '%Y-%m-%d') AS day,
      sha256('{"log_id":' || log_id || ',"correlation_id":' || coalesce(to_json(correlation_id)::VARCHAR, 'null') || ',"query_id":' || coalesce(to_json(query_id)::VARCHAR, 'null') || ',"k":' || coalesce(k::VARCHAR, 'null') || '}') AS h
      FROM search_log WHERE logged_at IS NOT NULL),
    x AS (SELECT day, count(*) AS rows, bit_xor(('0x' || substring(h, 1, 15))::BIGINT) AS a, bit_xor(('0x' || substring(h, 16, 15))::BIGINT) AS b, bit_xor(('0x' || substring(h, 31, 15))::BIGINT) AS c,
      bit_xor(('0x' || substring(h, 46, 15))::BIGINT) AS d, row_number() OVER (ORDER BY day) AS i FROM r GROUP BY day),
    s AS (SELECT i, day, rows, sha256('|' || concat_ws('|', day, rows, a, b, c, d)) AS sealed FROM x WHERE i = 1
      UNION ALL SELECT x.i, x.day, x.rows, sha256(s.sealed || '|' || concat_ws('|', x.day, x.rows, x.a, x.b, x.c, x.d)) FROM s JOIN x ON x.i = s.i + 1)
    SELECT day, rows, sealed FROM s"""
ORACLE = {
    "explain_validate": f"{_VALIDATED_SQL} SELECT key, attempt, problems FROM v",
    "explain_fallback": f"""{_VALIDATED_SQL}, b AS (SELECT key, min(attempt) AS attempt FROM v WHERE problems = '' GROUP BY key)
        SELECT query_id AS key, attempt, attempt IS NULL AS degraded, CASE WHEN attempt IS NULL THEN 'weak' END AS confidence FROM (SELECT DISTINCT query_id FROM gold_queries) LEFT JOIN b ON key = query_id""",
    "claim_scores": f"""WITH {R._CASES_SQL}, {R._branch_sql('doc', 'document')}, {_ANSWERS_SQL}
        SELECT key, attempt, row_number() OVER (PARTITION BY key, attempt ORDER BY c.case_id) - 1 AS position, c.case_id, 'differences' AS section, 0 AS claim_no, cites AS citations, coalesce(score, 0.0) AS score
        FROM claims c LEFT JOIN doc ON doc.query_id = key AND doc.case_id = c.case_id""",
    "audit_chain": _CHAIN_SQL,
    "filter_or_not": """SELECT row_no, sex, age, outcome_class FROM cases_clean
        WHERE coalesce((sex = 'female' AND age >= 60) OR outcome_class = 'deceased', false) AND NOT coalesce(len(quality_flags) > 0, false)""",
    "filter_version": f"WITH {R._CASES_SQL} SELECT 'lex-v1' AS embedding_version, age, count(*) AS cases FROM cases WHERE sex = 'female' AND month(built_at) % 2 = 0 GROUP BY age",
    "soft_preferences": f"""{R._FUSED_SQL}, p AS (SELECT query_id, case_id, rank, round(score + CASE WHEN sex = 'female' THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN age >= 60 THEN 0.05::DOUBLE ELSE 0 END, 6) AS preferred
        FROM fused JOIN cases USING (case_id) WHERE rank <= 30) SELECT query_id, case_id, preferred, row_number() OVER (PARTITION BY query_id ORDER BY preferred DESC, rank, case_id) AS new_rank FROM p""",
    "delete_by_filter": "SELECT coalesce(outcome_class = 'deceased' AND age <= 39, false) AS deleted, age_band, count(*) AS cases FROM cases_clean GROUP BY ALL",
    "log_dedup": f"SELECT log_id, correlation_id, query_id, k FROM {_LOG1}",
    "usage_daily": f"""SELECT strftime(requested_at, '%Y-%m-%d') AS day, profile, count(*) AS requests, count(*) FILTER (top_case_id IS NULL) AS empty,
        count(DISTINCT query_id) AS queries FROM {_LOG1} GROUP BY ALL""",
    "usage_rolling": """WITH c AS (SELECT CAST(requested_at AS DATE) AS day, count(*) AS requests FROM search_log GROUP BY 1)
        SELECT strftime(day, '%Y-%m-%d') AS day, requests, round(avg(requests) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 4) AS rolling FROM c""",
    "latency_percentiles": """WITH s AS (SELECT profile, list_sort(list(CAST(round(took_ms) AS BIGINT))) AS l, count(took_ms) AS n, avg(round(took_ms)) AS m FROM search_log WHERE took_ms IS NOT NULL GROUP BY profile)
        SELECT profile, n, l[1] AS min, l[n // 4 + 1] AS p25, CAST(floor((l[(n - 1) // 2 + 1] + l[n // 2 + 1]) / 2) AS BIGINT) AS median, l[3 * n // 4 + 1] AS p75,
        l[CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1] AS p95, l[n] AS max, round(m, 1) AS mean FROM s""",
    "cache_hit_rate": f"""WITH g AS (SELECT requested_at - lag(requested_at) OVER (PARTITION BY query_id, profile, k, sex, outcome_class, age_min ORDER BY requested_at, log_id) AS gap
        FROM {_LOG1} WHERE requested_at IS NOT NULL) SELECT count(*) AS requests, count(*) FILTER (gap <= INTERVAL 1 HOUR) AS hits FROM g""",
    "served_version": """SELECT l.log_id, (SELECT max_by(row_no, (built_at, row_no)) FROM cases_clean c WHERE c.case_id = l.top_case_id AND c.built_at <= l.requested_at) AS row_no
        FROM search_log l WHERE top_case_id IS NOT NULL""",
    "top_case_share": """WITH c AS (SELECT query_id, top_case_id, count(*) AS n, max(top_score) AS best FROM search_log WHERE top_case_id IS NOT NULL GROUP BY ALL)
        SELECT query_id, top_case_id, n, round(n / sum(n) OVER (PARTITION BY query_id), 4) AS share FROM c
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, best DESC, top_case_id DESC) = 1""",
    "mean_latency": f"SELECT profile, count(took_ms) AS requests, round(avg(took_ms), 1) AS mean_ms FROM {_LOG1} GROUP BY profile",
    "query_acceptance": r"""WITH a AS (SELECT lang, regexp_replace(text, '^[\s"]+|[\s"]+$', '', 'g') AS q FROM documents WHERE text IS NOT NULL),
        b AS (SELECT lang, regexp_replace(regexp_replace(q, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g'), '[\s\x{85}\p{Z}]+', ' ', 'g') AS q FROM a)
        SELECT lang, len(string_split(q, ' ')) BETWEEN 8 AND 45 AND NOT regexp_matches(lower(q), '^(?:i |sorry|here)') AS accepted, count(*) AS texts FROM b GROUP BY ALL""",
    "index_health": """SELECT *, CASE WHEN points > 0 THEN 'ok' ELSE 'degraded' END AS status FROM
        (SELECT count(DISTINCT case_id) AS points, count(case_id) - count(DISTINCT case_id) AS old_versions FROM cases_clean),
        (SELECT count(*) AS searches, count(*) FILTER (top_case_id IS NULL) AS empty_searches FROM search_log)""",
    "precision_by_month": f"""WITH m AS (SELECT strftime(requested_at, '%Y-%m') AS month, count(*) AS searches, CAST(sum(list_contains(relevant_case_ids, top_case_id)::INT) AS BIGINT) AS hits
        FROM {_LOG1} JOIN gold_queries USING (query_id) WHERE top_case_id IS NOT NULL GROUP BY 1)
        SELECT month, searches, hits, round(hits / searches - lag(hits / searches) OVER (ORDER BY month), 6) AS change FROM m""",
    "citation_validity": f"""WITH {R._CASES_SQL}, {R._branch_sql('doc', 'document')}, c AS (SELECT DISTINCT query_id, top_case_id AS case_id FROM search_log WHERE top_case_id IS NOT NULL)
        SELECT query_id, count(*) AS cited, count(doc.score) AS valid, round(count(doc.score) / count(*), 4) AS rate FROM c LEFT JOIN doc USING (query_id, case_id) GROUP BY query_id""",
    "outcome_cube": """SELECT sex, outcome, count(*) AS cases, round(avg(age), 4) AS mean_age, grouping_id(sex, outcome) AS level
        FROM (SELECT sex, lower(trim(outcome_class)) AS outcome, age FROM cases_clean) GROUP BY CUBE (sex, outcome)""",
    "outcome_pivot": "SELECT age_band, " + ", ".join(f"count(*) FILTER (lower(trim(outcome_class)) = '{c}') AS {c}" for c in ("improved", "deteriorated", "deceased", "unknown")) + " FROM cases_clean GROUP BY age_band",
    "index_reconcile": """WITH a AS (SELECT DISTINCT case_id FROM cases_clean WHERE case_id IS NOT NULL), b AS (SELECT case_id, count(*) AS documents FROM documents WHERE case_id IS NOT NULL GROUP BY 1)
        SELECT CASE WHEN a.case_id IS NULL THEN 'no_case' WHEN documents IS NULL THEN 'no_document' ELSE 'both' END AS found, count(*) AS cases, CAST(sum(coalesce(documents, 0)) AS BIGINT) AS documents
        FROM a FULL JOIN b ON a.case_id = b.case_id GROUP BY 1""",
    "resume_anti_join": "SELECT DISTINCT case_id FROM cases_clean WHERE case_id IS NOT NULL AND case_id NOT IN (SELECT top_case_id FROM search_log WHERE top_case_id IS NOT NULL)",
    "docs_semi_join": "SELECT row_no, case_id, substring(document, 1, 1600) AS text FROM cases_clean WHERE case_id IN (SELECT unnest(relevant_case_ids) FROM gold_queries)",
    "case_lookup": """WITH c AS (SELECT * FROM cases_clean QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY built_at DESC, row_no DESC) = 1),
        w AS (SELECT query_id, generate_subscripts(relevant_case_ids, 1) - 1 AS position, unnest(relevant_case_ids) AS case_id FROM gold_queries)
        SELECT query_id, position, case_id, row_no, length(document) AS n_chars FROM w JOIN c USING (case_id)""",
    "snippet_left_join": "SELECT vec_id, label, coalesce(substring(text, 1, 300), '') AS snippet FROM embeddings LEFT JOIN documents ON doc_id = vec_id",
    "group_by_case": """SELECT case_id, max_by(doc_id, (length(text), doc_id)) AS best_doc, max(length(text)) AS n_chars, count(DISTINCT note_section) AS sections
        FROM documents WHERE case_id IS NOT NULL AND text IS NOT NULL GROUP BY case_id""",
    "label_centroids": """SELECT label, i - 1 AS dim, round(avg(x::DOUBLE), 5) AS mean FROM (
        SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL""",
    "source_late_rows": """SELECT source, count(*) AS documents, count(*) FILTER (date_diff('day', written_at, loaded_at) >= 7) AS late, max(date_diff('day', written_at, loaded_at)) AS worst_days,
        count(*) FILTER (n_chars <> length(text)) AS stale_lengths FROM documents GROUP BY source""",
    "lab_trends": r"""WITH l AS (SELECT unnest(regexp_extract_all(document, '(?m)^([A-Za-z][A-Za-z -]+) \| (\d+(?:[.,]\d+)?) \| ([^\s|]+)\r?$')) AS line FROM cases_clean),
        p AS (SELECT string_split(line, ' | ') AS p FROM l), v AS (SELECT p[1] AS analyte, CAST(replace(p[2], ',', '.') AS DOUBLE) AS value, rtrim(p[3], chr(13)) AS unit FROM p)
        SELECT analyte, unit, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean FROM v GROUP BY ALL""",
    "lab_months": r"""WITH l AS (SELECT strftime(built_at, '%Y-%m') AS month, unnest(regexp_extract_all(document, '(?m)^([A-Za-z][A-Za-z -]+) \| (\d+(?:[.,]\d+)?) \| ([^\s|]+)\r?$')) AS line FROM cases_clean),
        p AS (SELECT month, string_split(line, ' | ') AS p FROM l), v AS (SELECT month, p[1] AS analyte, CAST(replace(p[2], ',', '.') AS DOUBLE) AS value, rtrim(p[3], chr(13)) AS unit FROM p),
        m AS (SELECT analyte, unit, month, count(*) AS n, avg(value) AS mean FROM v GROUP BY ALL)
        SELECT analyte, unit, month, n, round(mean, 4) AS mean, round(mean - lag(mean) OVER (PARTITION BY analyte, unit ORDER BY month), 4) AS change FROM m""",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
        SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events FROM s GROUP BY user_id, s""",
    "budget_packing": f"""{R._FUSED_SQL}, x AS (SELECT query_id, case_id, rank, CAST(sum(len(list_filter(regexp_split_to_array(document, '[\\s\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '')))
        OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS spent FROM fused JOIN cases USING (case_id) WHERE rank <= 30 AND document IS NOT NULL) SELECT * FROM x WHERE spent <= 3000""",
    "pricing_summary": f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, CAST(sum({_PRICE}) AS DOUBLE) AS revenue, count(*) AS lines
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "nation_revenue": f"""SELECT n_name, CAST(sum({_PRICE}) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
    "top_orders": """SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS rank
        FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY rank <= 3""",
    "negated_scopes": rf"""WITH p AS (SELECT row_no, document, regexp_split_to_array(document, '(?i){negation._TRIGGER}') AS seg,
          regexp_extract_all(document, '(?i){negation._TRIGGER}') AS trig FROM cases_clean WHERE document IS NOT NULL),
        w AS (SELECT row_no, list_transform(range(1, len(trig) + 1), lambda i: substring(document,
          CAST(1 + list_sum(list_transform(seg[1:i], lambda x: length(x))) + list_sum(list_transform(trig[1:i], lambda x: length(x))) AS BIGINT), 80)) AS l FROM p),
        s AS (SELECT row_no, list_filter(list_transform(l, lambda x: regexp_extract(x, '(?is)^(.*?)(?:{_END_SQL}|$)', 1)), lambda x: x <> '') AS l FROM w)
        SELECT row_no, len(l) AS n, md5(array_to_string(l, '|')) AS scopes FROM s""",
    "summary_checks": N._TREE + """, marks AS (SELECT line_no, coalesce(summary, '') AS s FROM augmented_notes_30k)
        SELECT line_no, CASE WHEN d.j IS NOT NULL THEN 'ok' WHEN contains(s, '{') AND NOT (json_valid(s) AND NOT regexp_matches(s, ',\\s*[}\\]]')) THEN 'repaired' ELSE 'failed' END AS status
        FROM marks LEFT JOIN docs d USING (line_no)""",
    "summary_leaves": N._TREE + f""", v AS (SELECT line_no, attribute, trim(value, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) AS value FROM leaves)
        SELECT line_no, attribute, value, count(*) AS n FROM v WHERE value IS NOT NULL AND value <> '[]' AND lower(value) NOT IN {T.EMPTY_WHEN_CLEANING} GROUP BY ALL""",
    "negated_spans": f"WITH {_scopes_sql('d', 'cases_clean', 'row_no', 'document')} SELECT k AS row_no, s AS start, e AS \"end\" FROM d_sc",
    "negation_parse_query": f"""WITH {_scopes_sql('q', 'gold_queries', 'query_id', 'query')}, {_polarity_sql('q')},
        a AS (SELECT query_id, count(*) AS asked FROM {_LOG1} WHERE query_id IS NOT NULL GROUP BY 1),
        l AS (SELECT k, list(w ORDER BY w) FILTER (NOT denied) AS positive, list(w ORDER BY w) FILTER (denied) AS negative FROM q_terms GROUP BY k)
        SELECT query_id, asked, coalesce(positive, []) AS positive, coalesce(negative, []) AS negative FROM a JOIN gold_queries USING (query_id) LEFT JOIN l ON k = query_id""",
    "document_polarity": f"""WITH {_scopes_sql('d', 'cases_clean', 'row_no', 'document')}, {_polarity_sql('d')}
        SELECT row_no, count(w) FILTER (NOT denied) AS asserted, count(w) FILTER (denied) AS denied FROM cases_clean LEFT JOIN d_terms ON k = row_no GROUP BY row_no""",
    "term_statuses": f"""WITH {R._CASES_SQL}, {R._branch_sql('doc', 'document', 30)},
        pool AS (SELECT query_id, case_id, substring(document, 1, 1600) AS text FROM doc JOIN cases USING (case_id)), {_status_sql('pool')} SELECT * FROM matched""",
    "search_fast": f"{R._FUSED_SQL}, top AS (SELECT query_id, case_id, score, rank FROM fused WHERE rank <= 30), {_adjusted_sql('top')}",
    "search_thorough": f"""{R._FUSED_SQL}, {R._rerank_ctes(50, 50, 0.9)},
        top AS (SELECT query_id, case_id, blend AS score, new_rank AS rank FROM rr), {_adjusted_sql('top')}""",
    "negation_triggers": f"SELECT trigger, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(document), '{negation._TRIGGER}')) AS trigger FROM cases_clean) GROUP BY trigger",
    "match_labels": f"""{R._FUSED_SQL} SELECT CASE WHEN score >= 0.5::DOUBLE THEN 'high' WHEN score >= 0.34::DOUBLE THEN 'moderate' ELSE 'weak' END AS label, count(*) AS hits
        FROM fused WHERE rank <= 10 GROUP BY 1""",
    "explain_context": """WITH c AS (SELECT * FROM cases_clean QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY built_at DESC, row_no DESC) = 1),
        w AS (SELECT query_id, generate_subscripts(relevant_case_ids, 1) AS position, unnest(relevant_case_ids) AS case_id FROM gold_queries),
        b AS (SELECT query_id, position, '=== CASE ' || case_id || ' (' || coalesce(sex, 'unknown') || ', ' || coalesce(age::VARCHAR, 'unknown') || ', ' || coalesce(outcome_class, 'unknown') || ') ===' || chr(10)
              || substring(coalesce(document, ''), 1, 4500) AS block FROM w JOIN c USING (case_id)),
        x AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY position) AS context FROM b GROUP BY query_id)
        SELECT query_id, md5(context) AS context, length(context) AS n_chars FROM x""",
    "explain_prompt": """WITH c AS (SELECT * FROM cases_clean QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY built_at DESC, row_no DESC) = 1),
        w AS (SELECT query_id, query, generate_subscripts(relevant_case_ids, 1) AS position, unnest(relevant_case_ids) AS case_id FROM gold_queries),
        b AS (SELECT query_id, query, position, '=== CASE ' || case_id || ' (' || coalesce(sex, 'unknown') || ', ' || coalesce(age::VARCHAR, 'unknown') || ', ' || coalesce(outcome_class, 'unknown') || ') ===' || chr(10)
              || substring(coalesce(document, ''), 1, 4500) AS block FROM w JOIN c USING (case_id)),
        x AS (SELECT query_id, 'QUERY' || chr(10) || query || chr(10) || chr(10) || 'CASES' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY position)
              || chr(10) || chr(10) || 'Compare each case with the query. Answer in JSON with explanations[]; cite case ids for every claim; give no advice.' AS prompt FROM b GROUP BY query_id, query)
        SELECT query_id, md5(prompt) AS prompt, length(prompt) AS n_chars FROM x""",
    "cache_keys": """SELECT log_id, 'explain:' || sha256('{"ids":["' || array_to_string(list_sort(list_prepend(top_case_id, relevant_case_ids)), '","') || '"],"q":"' || query || '","v":"v1"}') AS cache_key
        FROM search_log JOIN gold_queries USING (query_id) WHERE top_case_id IS NOT NULL""",
}
QUERIES = {
    f.__name__: f
    for f in (
        log_dedup, usage_daily, usage_rolling, latency_percentiles, cache_hit_rate, served_version, top_case_share, outcome_cube,
        outcome_pivot, index_reconcile, resume_anti_join, docs_semi_join, case_lookup, snippet_left_join, group_by_case, label_centroids,
        source_late_rows, lab_trends, lab_months, event_windows, event_sessions, budget_packing, pricing_summary, nation_revenue, top_orders,
        negated_scopes, negated_spans, negation_triggers, negation_parse_query, search_fast, search_thorough, match_labels,
        explain_context, explain_prompt, explain_validate, explain_fallback, citation_validity, cache_keys, summary_status, summary_checks, summary_leaves,
        claim_scores, audit_chain, filter_or_not, filter_version, soft_preferences, delete_by_filter, mean_latency, query_acceptance, document_polarity, index_health, precision_by_month, term_statuses,
    )
}
