"""Text expressions: cleaning, counting, hashing, normalisation of short fields. All but NFKC stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# What counts as empty, how sex is written, and the stems of outcomes.
EMPTY_VALUES = ("", "none", "n/a", "na", "unknown", "not applicable", "not specified", "-")
EMPTY_WHEN_CLEANING = (*EMPTY_VALUES, "null")
SEX_WORDS = {
    "male": ("male", "man", "boy", "gentleman", "m", "trans man"),
    "female": ("female", "woman", "girl", "lady", "f", "trans woman"),
}
DECEASED = r"(?i)\b(?:died|death|expired|deceased|passed away|fatal)\b"
DETERIORATED = r"(?i)\b(?:deteriorat|worsen|progress(?:ed|ion) of disease|relapse|recurren)\w*"
IMPROVED = (
    r"(?i)\b(?:improv|recover|resolv|discharged (?:home|in (?:a )?(?:stable|good))|stable condition|symptom[- ]free"
    r"|uneventful|good condition|well at follow)\w*"
)
AGE = r"(\d{1,3})\s*(?:-|–|\s)?\s*(year|yr|y/o|yo|month|week|day)?"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
PLACEHOLDERS = (r"\[\*\*.*?\*\*\]", r"\bXXXX+\b")
REDACTED = "[REDACTED]"
BROKEN_WORD = r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])"
# End of fixed values.


def _composed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


#: Compatibility composition; null for null. ASCII texts are passed through.
nfkc = F.pandas_udf(_composed, T.StringType())
#: The same, held back from being copied into filters, so that each text is composed once.
nfkc_once = F.pandas_udf(_composed, T.StringType()).asNondeterministic()


def strip(c: Column) -> Column:
    """Without white space of any kind around."""
    return F.regexp_replace(c, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")


def clean_layout(c: Column) -> Column:
    """Control characters, placeholders, broken hyphens, runs of blanks and empty lines."""
    c = F.regexp_replace(c, CONTROL, " ")
    for pattern in PLACEHOLDERS:
        c = F.regexp_replace(c, pattern, REDACTED)
    c = F.regexp_replace(c, BROKEN_WORD, "$1$2")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(c)


def clean_text(c: Column) -> Column:
    """The whole cleaning: NFKC, then layout."""
    return clean_layout(nfkc_once(c))


def word_count(c: Column) -> Column:
    """Stretches of characters that are no white space; null for null."""
    return F.size(F.filter(F.split(c, r"[\s\x{85}\p{Z}]+"), lambda w: w != "")).cast("long") + F.lit(0) * F.length(c)


def text_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def fallback(first: Column, second: Column) -> Column:
    """The first unless it is null or empty."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def normalize_sex(c: Column) -> Column:
    low = F.lower(F.trim(c))
    out = F.lit("unknown")
    for sex, words in SEX_WORDS.items():
        out = F.when(low.isin(*words), sex).otherwise(out)
    return out


def normalize_age(c: Column) -> Column:
    """First number of up to three digits; months, weeks and days are 0; null outside 0..120 and for empty values."""
    low = F.lower(F.trim(c))
    number, unit = F.regexp_extract(low, AGE, 1), F.regexp_extract(low, AGE, 2)
    years = F.when(unit.isin("month", "week", "day"), 0).otherwise(F.nullif(number, F.lit("")).cast("int"))
    return F.when(~low.isin(*EMPTY_WHEN_CLEANING) & (number != "") & years.between(0, 120), years)


def age_band(c: Column) -> Column:
    low = F.floor(c / 10) * 10
    return F.when(c.isNull(), "unknown").otherwise(F.concat_ws("-", low.cast("string"), (low + 9).cast("string")))


def outcome_class(document: Column, discharge: Column) -> Column:
    """By the discharge section and the last 15 % of the text; the gravest match wins."""
    tail = F.substring(document, (F.length(document) * F.lit(0.85)).cast("int") + 1, F.length(document))
    text = F.concat_ws(" ", F.coalesce(discharge, F.lit("")), F.coalesce(tail, F.lit("")))
    return (
        F.when(text.rlike(DECEASED), "deceased")
        .when(text.rlike(DETERIORATED), "deteriorated")
        .when(text.rlike(IMPROVED), "improved")
        .otherwise("unknown")
    )


def is_empty_value(c: Column, cleaning: bool = False) -> Column:
    return c.isNull() | F.lower(strip(c)).isin(*(EMPTY_WHEN_CLEANING if cleaning else EMPTY_VALUES))


def uuid5_dns(name: Column) -> Column:
    """Name-based UUID (version 5) in the DNS namespace."""
    space = F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def tokens(c: Column) -> Column:
    """Lower-case words of two or more letters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{2,}"), F.lit(0))


def unusual_unicode(c: Column, chars: int = 2000) -> Column:
    return F.substring(c, 1, chars).rlike(r"[\x{3000}-\x{10FFFF}]")


def match_label(score: Column) -> Column:
    """Clamped score as high, moderate or weak."""
    s = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return F.when(s >= 0.5, "high").when(s >= 0.34, "moderate").otherwise("weak")
