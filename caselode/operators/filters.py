"""Metadata filters as conjunctions of column predicates, applied before any top-n."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from caselode.config import DEFAULT

SEXES = ("male", "female", "unknown")
OUTCOMES = ("improved", "deteriorated", "deceased", "unknown")


@dataclass(frozen=True)
class SearchFilters:
    sex: str | None = None
    outcome_class: str | None = None
    age_min: int | None = None
    age_max: int | None = None
    any_of: dict[str, tuple] = field(default_factory=dict)
    prefixes: dict[str, str] = field(default_factory=dict)
    without_flags: tuple[str, ...] = ()
    embedding_version: str = DEFAULT.embedding_version

    def __post_init__(self) -> None:
        if self.sex is not None and self.sex not in SEXES:
            raise ValueError(f"unknown sex {self.sex!r}")
        if self.outcome_class is not None and self.outcome_class not in OUTCOMES:
            raise ValueError(f"unknown outcome class {self.outcome_class!r}")
        for age in (self.age_min, self.age_max):
            if age is not None and not 0 <= age <= 120:
                raise ValueError("ages are 0..120")

    def predicate(self) -> Column:
        """Null ages match no age range; age_min above age_max matches nothing."""
        parts: list[Column] = []
        if self.sex is not None:
            parts.append(F.col("sex") == self.sex)
        if self.outcome_class is not None:
            parts.append(F.col("outcome_class") == self.outcome_class)
        if self.age_min is not None:
            parts.append(F.col("age") >= self.age_min)
        if self.age_max is not None:
            parts.append(F.col("age") <= self.age_max)
        parts += [F.col(c).isin(*values) for c, values in self.any_of.items()]
        parts += [F.col(c).startswith(p) for c, p in self.prefixes.items()]
        parts += [~F.array_contains("quality_flags", f) for f in self.without_flags]
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        """Rows that match; of an index with versions only those of the one searched."""
        found = df.where(self.predicate())
        return found.where(F.col("embedding_version") == self.embedding_version) if "embedding_version" in df.columns else found


def any_of(*filters: SearchFilters | Column) -> Column:
    """True where any filter matches; null values match nothing."""
    return reduce(lambda a, b: a | b, [_matches(f) for f in filters], F.lit(False))


def all_of(*filters: SearchFilters | Column) -> Column:
    return reduce(lambda a, b: a & b, [_matches(f) for f in filters], F.lit(True))


def none_of(*filters: SearchFilters | Column) -> Column:
    """True where no filter matches; rows whose value is null don't match a filter, and so are kept."""
    return ~any_of(*filters)


def _matches(f: SearchFilters | Column) -> Column:
    return F.coalesce(f.predicate() if isinstance(f, SearchFilters) else f, F.lit(False))


def prefer(ranked: DataFrame, wishes: list[tuple[SearchFilters | Column, float]], key: str) -> DataFrame:
    """Soft preferences: each wish a row meets adds its weight to the score; nothing is filtered. Ties keep their rank."""
    bonus = reduce(lambda a, b: a + b, [F.when(_matches(f), F.lit(float(w))).otherwise(0.0) for f, w in wishes], F.lit(0.0))
    rows = ranked.withColumn("preferred", F.round(F.col("score") + bonus, 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("preferred"), "rank", key)
    return rows.withColumn("new_rank", F.row_number().over(w))


@dataclass(frozen=True)
class SearchRequest:
    query: str
    k: int = 10
    filters: SearchFilters = SearchFilters()
    rerank: bool = False

    def __post_init__(self) -> None:
        if not 3 <= len(self.query) <= 4000:
            raise ValueError("a query has 3..4000 characters")
        if not 1 <= self.k <= 25:
            raise ValueError("k is 1..25")


def check_explain_ids(ids: list[str]) -> list[str]:
    if not 1 <= len(ids) <= 5:
        raise ValueError("1..5 cases can be explained at once")
    return ids
