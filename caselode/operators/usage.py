"""Usage analytics over the search log and over event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caselode.operators.skew import salted_join


def distinct_requests(log: DataFrame) -> DataFrame:
    """A request logged several times counts once, by its first log_id; requests without correlation id stay."""
    keyed = log.where("correlation_id is not null")
    first = keyed.groupBy("correlation_id").agg(F.min("log_id").alias("log_id")).select("log_id")
    return keyed.join(first, "log_id", "left_semi").unionByName(log.where("correlation_id is null"))


def cache_hits(requests: DataFrame, keys: list[str], at: str, ident: str, ttl_s: int) -> DataFrame:
    """(ident, hit): was there an earlier request with the same key within ``ttl_s`` seconds?

    A key is looked at in stretches of ttl_s, so even a key with a third of all rows is many small groups; the first
    request of a stretch is compared with the last one of the stretch before.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = requests.where(F.col(at).isNotNull()).select(ident, F.xxhash64(*keys).alias("key"), micros.alias("t"))
    rows = rows.withColumn("stretch", F.floor(F.col("t") / (ttl_s * 1_000_000)))
    last = rows.groupBy("key", "stretch").agg(F.max("t").alias("before")).withColumn("stretch", F.col("stretch") + 1)
    w = Window.partitionBy("key", "stretch").orderBy("t", ident)
    within = rows.withColumn("prev", F.lag("t").over(w))
    joined = within.join(last, ["key", "stretch"], "left").withColumn("prev", F.coalesce("prev", "before"))
    return joined.select(ident, F.coalesce(F.col("t") - F.col("prev") <= ttl_s * 1_000_000, F.lit(False)).alias("hit"))


def as_of(events: DataFrame, versions: DataFrame, key: str, at: str, since: str, ident: str, value: str) -> DataFrame:
    """(ident, value): for each event the value of the latest version of its key not later than the event; null if none.

    The event side is dealt over salts, since one key may hold a third of it.
    """
    v = versions.where(F.col(key).isNotNull()).select(F.col(key), F.col(since).alias("_since"), F.col(value).alias("_value"))
    e = events.select(ident, key, F.col(at).alias("_at"))
    pairs = salted_join(e, v, [key], [ident]).where("_since <= _at")
    best = pairs.groupBy(ident).agg(F.max_by("_value", F.struct("_since", "_value")).alias(value))
    return e.select(ident).join(best, ident, "left")


def audit_chain(log: DataFrame, at: str, columns: list[str]) -> DataFrame:
    """(day, rows, sealed): a hash chain over the days of a log; a row changed, added or lost changes all later seals.

    Rows are digested (SHA-256) where they lie; a day's digest is the XOR of its rows' (four parts of 60 bits) with
    their number, which partial aggregates can form, so a day of any size is no hot group. The chain itself runs over
    one row a day. Repeated rows cancel out in the XOR but not in the number; rows without a time are left out.
    """
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.bit_xor(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("long")).alias(f"x{i}") for i in range(4)]
    days = log.where(F.col(at).isNotNull()).select(F.date_format(at, "yyyy-MM-dd").alias("day"), digest.alias("h")).groupBy("day").agg(F.count("*").alias("rows"), *parts)
    body = F.concat_ws("|", "day", "rows", *[f"x{i}" for i in range(4)])
    ordered = days.agg(F.array_sort(F.collect_list(F.struct("day", "rows", body.alias("body")))).alias("d"))  # a row a day
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["day"].alias("day"), x["rows"].alias("rows"), F.sha2(F.concat(F.coalesce(F.element_at(acc, -1)["sealed"], F.lit("")), F.lit("|"), x["body"]), 256).alias("sealed"))))
    start = F.expr("array(named_struct('day', CAST(NULL AS STRING), 'rows', CAST(0 AS BIGINT), 'sealed', ''))")
    return ordered.select(F.inline(F.filter(F.aggregate("d", start, step), lambda x: x["day"].isNotNull())))


def sessions(events: DataFrame, user: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions per user: bounds and number of events. Partial sessions are merged before the shuffle ends."""
    return (
        events.where(F.col(at).isNotNull())
        .groupBy(user, F.session_window(F.col(at).cast("timestamp"), gap).alias("s"))
        .agg(F.count("*").alias("events"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
        .select(user, "first_at", "last_at", "events")
    )


def rolling_mean(daily: DataFrame, day: str, value: str, days: int) -> DataFrame:
    """Mean of the last ``days`` days, by calendar (a row per day is expected, so the window is short)."""
    w = Window.orderBy(F.datediff(F.col(day), F.lit("1970-01-01"))).rangeBetween(-(days - 1), 0)
    return daily.withColumn("rolling", F.round(F.avg(value).over(w), 4))


def within_budget(ranked: DataFrame, cost: Column, budget: int) -> DataFrame:
    """The rows of each query, by rank, whose costs add up to at most ``budget``."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def lab_values(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, analyte, value, unit) of lines "analyte | value | unit"; decimal commas are read as points."""
    line = r"(?dm)^([A-Za-z][A-Za-z -]+) \| (\d+(?:[.,]\d+)?) \| ([^\s|]+)\r?$"
    found = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(line), F.lit(0))).alias("line"))
    parts = F.split("line", r" \| ")
    return found.select(key, parts[0].alias("analyte"), F.replace(parts[1], F.lit(","), F.lit(".")).cast("double").alias("value"), F.rtrim(parts[2], F.lit("\r")).alias("unit"))
