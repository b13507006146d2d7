"""Building, profiling and sampling the case corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caselode.config import DEFAULT, EngineConfig
from caselode.functions import json_repair, text as T
from caselode.session import cut_lineage


MAX_STRATA = 100_000


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The row of least ``order`` per key. The key's partial minima are merged, so a key of any size is no hot group."""
    first = df.groupBy(key.alias("_key")).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def latest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Idempotent upsert: of the rows of a key the one of greatest ``order``; null keys are kept as one key."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return top.select(*keys, "_row.*").select(*df.columns)


def latest_rows(df: DataFrame, key: str, at: str, ident: str) -> DataFrame:
    """Like ``latest_wins`` where rows have a unique id: only ids are grouped, and wide columns are shuffled at most once.

    Ties of ``at`` go to the greater id.
    """
    best = df.groupBy(key).agg(F.max_by(ident, F.struct(at, ident)).alias(ident)).select(ident)
    return df.join(best, ident, "left_semi")


def build_cases(raw: DataFrame, cfg: EngineConfig = DEFAULT, with_nfkc: bool = True) -> DataFrame:
    """Raw notes to clean cases: dedup on the original note, clean, drop short ones, derive the attributes.

    Expects line_no, idx, note, full_note, summary. Null notes count as one empty note. The running number of a
    line stands in for a missing idx.
    """
    clean = T.clean_text if with_nfkc else T.clean_layout
    first = keep_first(raw, T.text_hash(F.col("note")), "line_no")
    values = F.map_values(F.expr("try_variant_get(_v, '$.discharge', 'map<string,variant>')"))
    discharge = F.array_join(F.transform(values, lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))), " ")
    missing = F.col("_s.status") == "failed"
    return (
        first.withColumn("document", clean(T.fallback(F.col("full_note"), F.col("note"))))
        .where(T.word_count(F.col("document")) >= cfg.min_words)
        .withColumn("_s", json_repair.parsed(F.col("summary")))
        .withColumn("_v", F.try_parse_json("_s.json"))
        .withColumn("age", T.normalize_age(F.expr("""try_variant_get(_v, '$["patient information"].age', 'string')""")))
        .select(
            "line_no",
            F.concat(F.lit("acn-"), F.coalesce("idx", F.col("line_no").cast("string"))).alias("case_id"),
            "document",
            F.col("note").alias("reference_note"),
            F.col("_s.json").alias("summary"),
            F.col("_s.status").alias("summary_status"),
            T.normalize_sex(F.expr("""try_variant_get(_v, '$["patient information"].sex', 'string')""")).alias("sex"),
            "age",
            T.age_band(F.col("age")).alias("age_band"),
            T.outcome_class(F.col("document"), discharge).alias("outcome_class"),
            F.when(missing, F.array(F.lit("no_structured_summary"))).otherwise(F.slice(F.array(F.lit("")), 1, 0)).alias("quality_flags"),
        )
    )


def index_quantiles(df: DataFrame, value: Column, group: list[str] | None = None) -> DataFrame:
    """n, min, p25, median, p75, p95, max and mean; a quantile p is the value at index int(n p) of the sorted values.

    Works on the histogram: values are counted first, and only distinct values are ordered.
    """
    group = group or []
    hist = df.select(*group, value.alias("v")).where("v is not null").groupBy(*group, "v").agg(F.count("*").alias("c"))
    by = Window.partitionBy(*group).orderBy("v")
    whole = Window.partitionBy(*group)
    h = hist.withColumn("upto", F.sum("c").over(by)).withColumn("n", F.sum("c").over(whole))
    at = lambda index: F.min(F.when(F.col("upto") > index, F.col("v")))
    n = F.col("n")
    low, high = at(F.floor((n - 1) / 2)), at(F.floor(n / 2))
    return h.groupBy(*group).agg(
        F.first("n").alias("n"),
        F.min("v").alias("min"),
        at(F.floor(n / 4)).alias("p25"),
        F.floor((low + high) / 2).cast("long").alias("median"),
        at(F.floor(3 * n / 4)).alias("p75"),
        at(F.floor(n * F.lit(0.95))).alias("p95"),
        F.max("v").alias("max"),
        F.round(F.sum(F.col("v") * F.col("c")) / F.first("n"), 1).alias("mean"),
    )


def section_coverage(df: DataFrame, json_col: str) -> DataFrame:
    """Per top-level section of the valid summaries: how many fill it and in how many percent."""
    m = F.expr(f"try_variant_get(try_parse_json(`{json_col}`), '$', 'map<string,variant>')")
    parsed = df.select(m.alias("m")).where("m is not null")
    total = parsed.agg(F.count("*").alias("n"))
    filled = parsed.select(F.explode("m").alias("section", "v")).where(
        ~F.lower(F.trim(F.coalesce(F.expr("try_variant_get(v, '$', 'string')"), F.lit("")))).isin(*T.EMPTY_VALUES, "[]", "{}")
    )
    return (
        filled.groupBy("section")
        .agg(F.count("*").alias("filled"))
        .crossJoin(F.broadcast(total))  # one row
        .select("section", "filled", F.round(100 * F.col("filled") / F.col("n"), 1).alias("percent"))
    )


def stratified_sample(df: DataFrame, strata: list[str], key: str, size: int, seed: int = 42, at_least_one: bool = False) -> DataFrame:
    """A deterministic sample of ``size`` rows in proportion to the strata.

    Quota of a stratum: round(size x n / N), half to even, at most n (with ``at_least_one`` at least 1). Order in a
    stratum: hash of key and seed. Missing rows are topped up and surplus ones cut in hash order. Keys are taken as
    unique. Rows whose hash lies beyond a threshold set by the quota never leave their scan, so no stratum is sorted as
    a whole; should a threshold have let too few rows through, it is raised. Quotas are broadcast; more than MAX_STRATA
    strata raise ValueError.
    """
    counts = cut_lineage(df.groupBy(*strata).agg(F.count("*").alias("_n")).limit(MAX_STRATA + 1))
    total = counts.agg(F.count("*").alias("strata"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()
    if total["strata"] > MAX_STRATA:
        raise ValueError(f"over {MAX_STRATA} strata")
    quota = F.least(F.bround(F.lit(size) * F.col("_n") / F.lit(max(total["rows"], 1))), F.col("_n")).cast("long")
    quotas = counts.withColumn("_q", F.greatest(F.lit(1), quota) if at_least_one else quota)
    missing = max(0, size - (quotas.agg(F.sum("_q")).first()[0] or 0))  # what the top-up takes at most of one stratum
    quotas = quotas.withColumn("_need", F.least(F.col("_q") + missing, F.col("_n")))
    rows = df.withColumn("_h", F.sha2(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))), 256))
    on = [F.col(f"r.{s}").eqNullSafe(F.col(f"q.{s}")) for s in strata]
    joined = rows.alias("r").join(F.broadcast(quotas.alias("q")), on).select("r.*", "q._q", "q._n", "q._need")
    place = F.conv(F.substring("_h", 1, 13), 16, 10).cast("double") / float(1 << 52)
    room, short = 1.5, True
    while short:
        some = cut_lineage(joined.where(place < (F.col("_need") * room + 30) / F.col("_n")))
        passed = some.groupBy("_n", "_need", *strata).agg(F.count("*").alias("_c")).where("_c < _need")
        empty = quotas.join(some.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)]).distinct(), [F.col(s).eqNullSafe(F.col(f"_s{i}")) for i, s in enumerate(strata)], "left_anti").where("_need > 0")
        short = passed.limit(1).count() + empty.limit(1).count() > 0
        room *= 4
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy("_h", key)))
    taken = ranked.withColumn("_extra", F.col("_r") > F.col("_q"))
    return taken.orderBy("_extra", "_h", key).limit(size).select(*df.columns)
