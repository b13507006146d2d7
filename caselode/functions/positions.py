"""Column expressions over the positions of regular-expression matches. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_totals(numbers: Column) -> Column:
    """Sums up to and including each element. Blocks of elements are summed first, so long arrays take linear time."""
    grown = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    zero = F.array(F.lit(0).cast("long"))
    parts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(numbers) - 1, F.lit(0)) / _BLOCK).cast("int"))
    blocks = F.transform(parts, lambda b: F.aggregate(F.slice(numbers, b * _BLOCK + 1, _BLOCK), zero, grown))

    def joined(b: Column) -> Column:
        starts = F.aggregate(b, zero, lambda acc, one: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(one, -1))))
        return let(starts, lambda s: F.flatten(F.transform(b, lambda one, i: F.transform(F.slice(one, 2, F.size(one)), lambda x: x + F.get(s, i)))))

    return let(blocks, joined)


def _placed(lengths: Column, words: Column) -> Column:
    return F.zip_with(words, lengths, lambda w, to: F.struct(w.alias("word"), (to - F.length(w)).alias("start"), to.alias("end")))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<word, start, end>> of all matches, from the lengths of what stands between them."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("words"), F.split(text, pattern).alias("gaps"))

    def placed(p: Column) -> Column:
        steps = F.zip_with(p["words"], F.slice(p["gaps"], 1, F.size(p["words"])), lambda w, g: (F.length(w) + F.length(g)).cast("long"))
        return let(steps, lambda s: _placed(running_totals(s), p["words"]))

    return let(parts, placed)


def occurrences(text: Column, term: Column) -> Column:
    """Start positions of a literal term, whatever its letter case; occurrences don't overlap. None for the empty term."""
    gaps = F.split(text, F.concat(F.lit(r"(?iu)\Q"), term, F.lit(r"\E")))

    def starts(g: Column) -> Column:
        steps = F.transform(F.slice(g, 1, F.size(g) - 1), lambda x: (F.length(x) + F.length(term)).cast("long"))
        return let(steps, lambda s: F.transform(running_totals(s), lambda end: end - F.length(term)))

    return F.when(term != "", let(gaps, starts)).otherwise(F.slice(F.array(F.lit(0).cast("long")), 1, 0))
