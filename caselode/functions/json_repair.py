"""Tolerant JSON as column expressions: repair, status and pruning. Nothing leaves the JVM.

Accepted defects of an object: code fences and text around it, control characters, commas before closers, quotes
inside strings, a cut-off end (open strings, an unfinished last member, missing closers).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caselode.functions.positions import let
from caselode.functions.text import EMPTY_WHEN_CLEANING

_STRING = r'"(?:[^"\\]|\\.)*+"'
_BLANK = r"(?:[\s\x{85}\p{Z}]|\\[nrtf])"
_LAST_MEMBER = rf"(?:,\s*|(?<=[{{\[])\s*)(?:{_STRING}\s*:?)?\s*[\w.+-]*\s*$"
_EMPTY_TEXT = '"(?i:' + "|".join(EMPTY_WHEN_CLEANING) + ')"'
_EMPTY = rf"(?:null|\{{\}}|\[\]|{_EMPTY_TEXT})"
#: an empty member, an empty item, or (kept) a string
_DROPPED = rf"{_STRING}:{_EMPTY}(?=[,}}])|(?<=[\[,]){_EMPTY}(?=[,\]])|({_STRING})"
_COMMAS = rf"({_STRING})|(?<=[{{\[]),+|,+(?=[}}\]])|,(?=,)"


def _object(text: Column) -> Column:
    """The JSON object a text is, or that stands in it as a JSON string; else null. An object may be followed by nothing."""
    value = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.when((F.size(items) == 1) & F.try_variant_get(items[0], "$", "map<string,variant>").isNotNull(), items[0])


def strict_object(text: Column) -> Column:
    """VARIANT of a well-formed object, directly or as the content of a JSON string."""
    return F.coalesce(_object(text), _object(F.try_variant_get(F.try_parse_json(text), "$", "string")))


def _closers(text: Column) -> Column:
    """The closers a text lacks, innermost first."""
    marks = F.regexp_replace(F.regexp_replace(text, _STRING, ""), r"[^\[\]{}]++", "")
    opened = lambda s, c: F.when(c == "{", F.concat(F.lit("}"), s)).when(c == "[", F.concat(F.lit("]"), s)).when(c.isin("}", "]"), F.substring(s, 2, 1 << 30)).otherwise(s)
    return F.aggregate(F.split(marks, ""), F.lit(""), opened)


def repaired_object(text: Column) -> Column:
    """VARIANT of the first repair of a text that is an object with members; else null."""
    whole = F.regexp_replace(F.regexp_extract(text, r"(?s)\{.*", 0), r"\s*`{3}\s*$", "")
    bare = F.regexp_replace(whole, r"[\x00-\x1f]", " ")
    quoted = F.regexp_replace(bare, r'(?<![{\[,:]\s{0,20})(?<!\\)"(?!\s*(?:[,:}\]]|$))', r'\\"')
    tidy = F.regexp_replace(quoted, rf"({_STRING})|,(?=\s*(?:[}}\]]|$))", "$1")
    ended = let(tidy, lambda t: F.when(F.contains(F.regexp_replace(t, _STRING, ""), F.lit('"')), F.concat(F.regexp_replace(t, r"\\$", ""), F.lit('"'))).otherwise(t))

    def tried(t: Column) -> Column:
        shorter = F.regexp_replace(t, _LAST_MEMBER, "")
        ways = [
            F.regexp_extract(t, r"(?s)^.*\}", 0),
            F.concat(t, _closers(t)),
            F.concat(t, F.lit("null"), _closers(t)),
            let(shorter, lambda s: F.concat(s, _closers(s))),
        ]
        found = F.coalesce(*[_object(way) for way in ways])
        return F.when(F.size(F.try_variant_get(found, "$", "map<string,variant>")) > 0, found)

    return let(ended, tried)


def pruned(value: Column) -> Column:
    """JSON text of a VARIANT object without empty values at any depth; a container left empty is empty too.

    Strings lose the blanks around them. Each pass drops what is empty by itself; as many passes as there are levels.
    """
    text = F.to_json(value)
    text = F.regexp_replace(text, rf'((?<=[:\[,])")(?!(?:[^"\\]|\\.)*+":){_BLANK}++', "$1")
    text = F.regexp_replace(text, rf'(?<!\\){_BLANK}++(?="[,}}\]])', "")
    once = lambda t: F.regexp_replace(F.regexp_replace(t, _DROPPED, "$1"), _COMMAS, "$1")
    marks = lambda t: F.regexp_replace(F.regexp_replace(t, _STRING, ""), r"[^\[\]{}]++", "")

    def depth(t: Column) -> Column:
        zero = F.struct(F.lit(0).alias("now"), F.lit(1).alias("most"))
        step = lambda a, c: let(a["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0), lambda n: F.struct(n.alias("now"), F.greatest(a["most"], n).alias("most")))
        return F.aggregate(F.split(marks(t), ""), zero, step, lambda a: a["most"])

    return let(text, lambda t: F.aggregate(F.sequence(F.lit(1), depth(t)), t, lambda now, _: once(now)))


def parsed(text: Column) -> Column:
    """struct<json, status>: the pruned object as text (null if there is none) and ok, repaired or failed."""

    def told(v: Column) -> Column:
        found = F.coalesce(v["ok"], v["mended"])
        status = F.when(v["ok"].isNotNull(), "ok").when(v["mended"].isNotNull(), "repaired").otherwise("failed")
        return F.struct(F.when(found.isNotNull(), pruned(found)).alias("json"), status.alias("status"))

    def tried(ok: Column) -> Column:
        # texts that are some other JSON value are no damaged objects
        mended = F.when(ok.isNull() & F.try_parse_json(text).isNull(), repaired_object(text))
        return let(F.struct(ok.alias("ok"), mended.alias("mended")), told)

    return let(strict_object(text), tried)
