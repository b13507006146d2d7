"""Everything around a model's explanation: context, output checks, fallbacks, cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caselode.config import DEFAULT, EngineConfig

# Phrasing an explanation must not use.
BANNED = (
    r"(?i)\bthe (?:query )?patient (?:has|is suffering from|should)\b",
    r"(?i)\b(?:you|the clinician) should (?:prescribe|administer|order|start)\b",
    r"(?i)\bdiagnosis (?:for the query patient )?is\b",
    r"(?i)\bwe (?:diagnose|recommend treating)\b",
)
# End of fixed values.

CLAIMS = "array<struct<detail:string,factor:string,treatment:string,outcome_note:string,citations:array<string>>>"
SCHEMA = f"explanations array<struct<case_id:string,similarity_factors:{CLAIMS},differences:{CLAIMS},treatments_observed:{CLAIMS},confidence:string>>"
SECTIONS = ("similarity_factors", "differences", "treatments_observed")


def context(requested: DataFrame, cases: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One context per query: header and text of each requested case in request order.

    requested: query_id, case_id, position; cases: case_id, sex, age, outcome_class, document. Unknown ids are left out.
    """
    header = F.format_string(
        "=== CASE %s (%s, %s, %s) ===",
        "case_id", F.coalesce("sex", F.lit("unknown")), F.coalesce(F.col("age").cast("string"), F.lit("unknown")), F.coalesce("outcome_class", F.lit("unknown")),
    )
    block = F.concat_ws("\n", header, F.substring(F.coalesce("document", F.lit("")), 1, cfg.context_chars))
    rows = requested.join(cases, "case_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", block.alias("block")))).alias("b"))
    return rows.select("query_id", F.array_join(F.col("b.block"), "\n\n").alias("context"))


def prompt(query: Column, block: Column) -> Column:
    """The request to a model: query, cases, and the rules its answer is checked by."""
    return F.concat(
        F.lit("QUERY\n"), query, F.lit("\n\nCASES\n"), block,
        F.lit("\n\nCompare each case with the query. Answer in JSON with explanations[]; cite case ids for every claim; give no advice."),
    )


def missing_ids(requested: DataFrame, cases: DataFrame) -> DataFrame:
    return requested.join(cases.select("case_id"), "case_id", "left_anti")


def extract_json(raw: Column) -> Column:
    """The JSON of a model's answer: code fences off, else from the first { to the last }; null if neither parses."""
    bare = F.trim(F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(bare).isNotNull(), bare).when(F.try_parse_json(inner).isNotNull(), F.nullif(inner, F.lit("")))


def validate(outputs: DataFrame, valid: DataFrame) -> DataFrame:
    """(key, problems): outputs (key, attempt, raw) against the ids a key may cite (key, case_id). No problems: valid.

    Problems: no_output, no_explanations, unknown_case, uncited_claim, bad_citation, banned_phrase.
    """
    allowed = valid.groupBy("key").agg(F.collect_set("case_id").alias("allowed"))  # at most the ids of one request
    text = extract_json(F.col("raw"))
    o = outputs.withColumn("json", text).withColumn("x", F.from_json("json", SCHEMA)).join(allowed, "key", "left")
    ok = F.coalesce("allowed", F.slice(F.array(F.lit("")), 1, 0))
    exps = F.coalesce(F.col("x.explanations"), F.from_json(F.lit("[]"), SCHEMA.split(" ", 1)[1]))
    claims = F.flatten(F.transform(exps, lambda e: F.concat(*[F.coalesce(e[s], F.from_json(F.lit("[]"), CLAIMS)) for s in SECTIONS])))
    cited = F.flatten(F.transform(claims, lambda c: F.coalesce(c["citations"], F.slice(F.array(F.lit("")), 1, 0))))
    banned = F.lit(False)
    for pattern in BANNED:
        banned = banned | F.col("json").rlike(pattern)
    tests = {
        "no_output": F.col("json").isNull(),
        "no_explanations": F.col("json").isNotNull() & (F.size(exps) == 0),
        "unknown_case": F.exists(exps, lambda e: ~F.array_contains(ok, e["case_id"])),
        "uncited_claim": F.exists(claims, lambda c: F.size(F.coalesce(c["citations"], F.slice(F.array(F.lit("")), 1, 0))) == 0),
        "bad_citation": F.exists(cited, lambda c: ~F.array_contains(ok, c)),
        "banned_phrase": banned,
    }
    problems = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()]), lambda p: p.isNotNull())
    return o.select("key", "attempt", "json", problems.alias("problems"))


def claim_scores(outputs: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per claim of each answer (key, attempt, raw), with the retrieval score of its case (key, case_id, score).

    A case the search did not list scores 0; ``citations`` counts what the claim cites. An answer without JSON has none.
    """
    parsed = outputs.select("key", "attempt", F.from_json(extract_json(F.col("raw")), SCHEMA).alias("x"))
    each = parsed.select("key", "attempt", F.posexplode("x.explanations").alias("position", "e"))
    sections = F.array(*[F.struct(F.lit(name).alias("section"), F.col("e")[name].alias("claims")) for name in SECTIONS])
    told = each.select("key", "attempt", "position", F.col("e.case_id").alias("case_id"), F.explode(sections).alias("s"))
    claims = told.select("key", "attempt", "position", "case_id", "s.section", F.posexplode("s.claims").alias("claim_no", "c"))
    found = claims.join(scores.select("key", "case_id", "score"), ["key", "case_id"], "left")
    return found.select(
        "key", "attempt", "position", "case_id", "section", "claim_no", F.size(F.coalesce("c.citations", F.expr("array()"))).alias("citations"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def first_valid(validated: DataFrame, keys: DataFrame) -> DataFrame:
    """Per key the first valid attempt; without one a degraded answer with confidence weak and model none."""
    best = validated.where(F.size("problems") == 0).groupBy("key").agg(F.min_by("json", "attempt").alias("json"), F.min("attempt").alias("attempt"))
    return keys.select("key").distinct().join(best, "key", "left").select(
        "key", "json", "attempt", F.col("json").isNull().alias("degraded"), F.when(F.col("json").isNull(), "weak").alias("confidence")
    )


def cache_key(query: Column, ids: Column, version: str = DEFAULT.prompt_version) -> Column:
    """Independent of the order of ids."""
    body = F.concat(F.lit('{"ids":["'), F.array_join(F.sort_array(ids), '","'), F.lit('"],"q":"'), query, F.lit(f'","v":"{version}"}}'))
    return F.concat(F.lit("explain:"), F.sha2(body, 256))


def cache_put(cache: DataFrame, new: DataFrame, now: Column, ttl_s: int = DEFAULT.cache_ttl_s) -> DataFrame:
    """cache (key, value, expires_at) with new (key, value): the later expiry of a key wins."""
    fresh = new.select("key", "value", (now + F.make_interval(secs=F.lit(ttl_s))).alias("expires_at"))
    both = cache.unionByName(fresh)
    return both.groupBy("key").agg(F.max_by("value", "expires_at").alias("value"), F.max("expires_at").alias("expires_at"))


def cache_get(cache: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now).join(keys.select("key").distinct(), "key", "left_semi")
