"""Samples that match target category proportions (problem 1).

Systematic unequal-probability sampling. Within the sorted categories the cases are put in random order by a
range partitioning; a case of category c has inclusion probability pi = min(1, share x size / available).
Prefix sums of pi run over all partitions: each partition's counts give its offset, so no partition sees
another one's rows. From one random start u per plan a case is taken where floor(sum + u) steps up.
Because pi is constant within a category, the prefix sum before the r-th case is base + r x pi, and how many
cases before it were taken is known without a second pass; floors are repaired by the same arithmetic:
categories below min(min_rows, available) take their first cases not yet taken, and where that makes a plan
larger than sample_size, the categories with the largest surplus over their floor give back their last ones.
A category with fewer cases than needed gives nothing back: all its cases are in the sample, and the report finds it
by what was drawn (``sampled`` = available, yet less than needed).

Defined results: letter case and outer blanks of a category don't matter; null categories and null ids are no
cases; a case written several times counts once per category; a plan's shares need not add up to 1 (each is
taken of sample_size as it stands); a category without cases is reported short by all that is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caselode.operators.skew import broadcast_if_small
from caselode.session import cut_lineage

MAX_TARGETS = 100_000


def category(column: Column) -> Column:
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def ordered_cases(cases: DataFrame, case_id: str, class_col: str, seed: int) -> DataFrame:
    """(case_id, cls, rank): distinct cases, rank from 0 in the random order of their category."""
    distinct = (
        cases.select(F.col(case_id).alias("case_id"), category(F.col(class_col)).alias("cls"))
        .where("case_id is not null and cls is not null")
        .distinct()
        .withColumn("rnd", F.xxhash64("case_id", F.lit(seed)))
    )
    laid = distinct.repartitionByRange("cls", "rnd", "case_id").sortWithinPartitions("cls", "rnd", "case_id")
    place = F.monotonically_increasing_id()
    laid = cut_lineage(
        laid.withColumn("place", place).select(
            "case_id", "cls", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("at")
        )
    )
    # one row per partition and category in it: partitions + categories rows in all
    parts = laid.groupBy("part", "cls").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", "cls", (before - F.col("first")).alias("shift"))
    return laid.join(broadcast_if_small(cut_lineage(offsets)), ["part", "cls"]).select("case_id", "cls", (F.col("at") + F.col("shift")).alias("rank"))


def quotas(targets: DataFrame, available: DataFrame, seed: int) -> DataFrame:
    """Per plan and category: what is needed, there, taken by the systematic draw, and taken after the repair."""
    t = targets.select(
        "plan_id", "outcome_class", category(F.col("outcome_class")).alias("cls"), "target_share", "min_rows", "sample_size"
    ).join(available, "cls", "left")
    wanted = F.col("target_share") * F.col("sample_size")
    plan = Window.partitionBy("plan_id")
    in_order = plan.orderBy("cls", "outcome_class")
    t = (
        t.withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("needed", F.greatest(F.coalesce("min_rows", F.lit(0)), F.round(wanted)).cast("long"))
        .withColumn("pi", F.when(F.col("available") > 0, F.least(F.lit(1.0), wanted / F.col("available"))).otherwise(0.0))
        .withColumn("u", F.pmod(F.xxhash64("plan_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
        .withColumn("mass", F.col("pi") * F.col("available"))
        .withColumn("base", F.coalesce(F.sum("mass").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.col("u"))
        .withColumn("drawn", F.floor(F.col("base") + F.col("mass") + 1e-9) - F.floor(F.col("base")))
        .withColumn("drawn", F.least("drawn", "available"))
        .withColumn("floor", F.when(F.col("available") < F.col("needed"), F.col("available")).otherwise(F.least(F.coalesce("min_rows", F.lit(0)).cast("long"), "available")))
        .withColumn("raised", F.greatest("drawn", "floor"))
        .withColumn("over", F.greatest(F.sum("raised").over(plan) - F.greatest("sample_size", F.sum("drawn").over(plan)), F.lit(0)))
        .withColumn("spare", F.col("raised") - F.col("floor"))
    )
    givers = plan.orderBy(F.desc("spare"), "cls", "outcome_class")
    given_before = F.coalesce(F.sum("spare").over(givers.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gives = F.greatest(F.least(F.col("spare"), F.col("over") - given_before), F.lit(0))
    return t.withColumn("taken", F.col("raised") - gives).drop("mass", "u", "over", "spare", "raised")


def proportional_sample(cases: DataFrame, targets: DataFrame, case_id: str = "case_id", class_col: str = "outcome_class", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sample, report): the cases drawn per plan, and per plan and category needed, available, drawn and short.

    ``targets`` is broadcast after its size has been checked (at most MAX_TARGETS rows).
    """
    if targets.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError(f"over {MAX_TARGETS} target rows: split the plans")
    ordered = ordered_cases(cases, case_id, class_col, seed)
    available = ordered.groupBy("cls").agg(F.count("*").alias("available"))
    plan = cut_lineage(quotas(targets, available, seed))
    joined = ordered.join(F.broadcast(plan), "cls")
    r, pi, base = F.col("rank"), F.col("pi"), F.col("base")
    crosses = F.floor(base + (r + 1) * pi + 1e-9) > F.floor(base + r * pi + 1e-9)
    taken_before = F.floor(base + r * pi + 1e-9) - F.floor(base + 1e-9)
    sample = joined.where(
        (crosses & (taken_before < F.col("taken"))) | (~crosses & (r - taken_before < F.col("taken") - F.col("drawn")))
    ).select("plan_id", "outcome_class", "case_id")
    counts = sample.groupBy("plan_id", "outcome_class").agg(F.count("*").alias("sampled"))
    sampled = F.coalesce("sampled", F.lit(0))
    # short: the draw took all there are, and that is less than needed
    short = F.when((sampled < F.col("needed")) & (sampled == F.col("available")), F.col("needed") - sampled).otherwise(0)
    report = plan.join(counts, ["plan_id", "outcome_class"], "left").select(
        "plan_id", "outcome_class", "target_share", "min_rows", "sample_size", "needed", "available",
        sampled.alias("sampled"), short.alias("short_by"),
    )
    return sample, report
