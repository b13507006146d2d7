"""Cutting oversized texts at natural boundaries (problem 3).

Every position between two units (characters, words or UTF-8 bytes) has a boundary strength: section 6,
paragraph 5, line or list item 4 (not the wrapped line of a sentence), sentence 3, clause 2, word 1, none 0; positions inside a character or a
line break are not permitted at all. For a piece that starts at s the cut is the strongest position in the
window [s + least, s + max_size], ties broken to the right; where that holds no boundary, the strongest one
before it that still lets the next piece go on; the next piece starts ``overlap`` units before the cut. Range maxima come from a sparse table whose entries hold strength and position in one integer, so
the maximum is its own rightmost argument; all windows of one limit have the same length, so just the table's
row for that length is kept while it is built.

Defined results: null and empty texts and texts of exactly max_size or less give no pieces; a text without any
boundary is cut at max_size; where a piece would start inside a character (bytes), it starts before it;
overlap must be smaller than max_size. Texts are processed whole, one at a time, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SECTION, PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, NONE = 6, 5, 4, 3, 2, 1, 0
KINDS = ("none", "word", "clause", "sentence", "line", "paragraph", "section")
MAX_LIMITS = 1000
_HEADING = re.compile(r"(?:\A|(?<=\n))(?=(?:#{1,6}[ \t]+\S|[^\W\d_][^\n.!?|;,]{1,48}:?[ \t]*\r?\n))")
_SHIFT = 40
_ENDS = np.array([46, 33, 63, 58, 59, 0x2026, 0x3002])


def _spaces(cp: np.ndarray) -> np.ndarray:
    return (cp == 32) | (cp == 9) | (cp == 10) | (cp == 13)


def strengths(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Strength of a cut before each code point and after the last; the code points."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(cp)
    out = np.zeros(n + 1, dtype=np.int8)
    out[n] = SECTION
    if n < 2:
        return out, cp
    space = _spaces(cp) | (cp == 0xA0)
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if len(starts):
        last = np.maximum.accumulate(np.where(space, -1, np.arange(n)))[starts - 1]  # character before the gap
        before = np.where(last >= 0, cp[np.maximum(last, 0)], 0)
        closes = np.isin(before, [34, 39, 41, 93, 0x201D, 0x2019, 0xBB])
        before = np.where(closes & (last >= 1), cp[np.maximum(last - 1, 0)], before)
        level = np.full(len(starts), WORD, dtype=np.int8)
        level[np.isin(before, [44, 59, 58])] = CLAUSE
        level[np.isin(before, [46, 33, 63, 0x2026, 0x3002])] = SENTENCE
        breaks = np.concatenate([[0], np.cumsum(cp == 10)])
        lines = breaks[starts] - breaks[last + 1]
        # a line break inside a sentence (nothing ends before it, and small letters go on) is no pause
        single = np.flatnonzero(lines == 1)
        goes_on = np.fromiter((chr(c).islower() for c in cp[starts[single]]), dtype=bool, count=len(single))
        level[single[~goes_on | np.isin(before[single], _ENDS)]] = LINE
        level[lines > 1] = PARAGRAPH
        out[starts] = level
        for m in _HEADING.finditer(text):
            if (p := m.start()) and out[p] >= LINE and (out[p] == PARAGRAPH or text[p] == "#"):
                out[p] = SECTION
    marks = ((cp >= 0x300) & (cp < 0x370)) | ((cp >= 0x200B) & (cp < 0x2010)) | ((cp >= 0xFE00) & (cp < 0xFE10))
    out[:n][marks] = -1
    out[1:n][(cp[1:] == 10) & (cp[:-1] == 13)] = -1
    return out, cp


def rightmost_maxima(strength: np.ndarray, length: int) -> np.ndarray:
    """Row of the sparse table for windows of ``length``: entry i packs the rightmost maximum of [i, i + length)."""
    n = len(strength)
    row = (strength.astype(np.int64) + 1 << _SHIFT) + np.arange(n)
    span = 1
    while span * 2 <= length:
        row = np.maximum(row[: len(row) - span], row[span:])
        span *= 2
    return np.maximum(row[: n - length + 1], row[length - span : length - span + n - length + 1])


def cuts(strength: np.ndarray, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece in units; [] where all fits into one."""
    n = len(strength) - 1
    if n <= max_size:
        return []
    if not 0 <= overlap < max_size:
        raise ValueError("overlap must be at least 0 and smaller than max_size")
    least = max(overlap + 1, (max_size + 1) // 2)  # a piece is shorter only where no boundary stands beyond, and each step goes on
    length = max_size - least + 1
    row = rightmost_maxima(strength, length)
    pieces, s, last = [], 0, 0
    while n - s > max_size:
        best = int(row[s + least])
        e = best & ((1 << _SHIFT) - 1)
        level = best >> _SHIFT  # one more than the strength
        first = max(s + overlap, last) + 1
        if (e <= last or level <= NONE + 1) and (part := strength[first : s + max_size + 1]).size and part.max() > NONE:
            # no boundary in the window: the strongest of the whole piece rather than a cut inside a word
            e = first + len(part) - 1 - int(part[::-1].argmax())
        elif e <= last or level == 0:
            # the start was moved back, or nothing is permitted in the window: the rightmost permitted cut beyond the last one
            free = np.flatnonzero(strength[last + 1 : s + max_size + 1] >= 0)
            if not len(free) and last > s:
                s = last  # the overlap leaves no room for a permitted cut: go on without it
                continue
            e = last + 1 + int(free[-1]) if len(free) else s + max_size
        pieces.append((s, e))
        back = e - overlap
        while back > s + 1 and strength[back] < 0:
            back -= 1
        s, last = (back if s < back and strength[back] >= 0 and back + max_size > e else e), e
    pieces.append((s, n))
    return pieces


def pieces(text: str, unit: str, max_size: int, overlap: int, known: dict | None = None) -> list[tuple[int, int, int, int]]:
    """(start, end, size, strength of the cut at the end) of each piece; start and end in code points."""
    if not text or (unit == "chars" and len(text) <= max_size) or (unit == "bytes" and len(text) * 4 <= max_size):
        return []
    known = {} if known is None else known
    if "chars" not in known:
        known["chars"] = strengths(text)
    by_char, cp = known["chars"]
    if unit == "chars":
        places, s = None, by_char
    elif unit == "bytes":
        width = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(width)])
        s = np.full(at[-1] + 1, -1, dtype=np.int8)
        s[at] = by_char
        places = at
    elif unit == "words":
        space = _spaces(cp)
        first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        s = np.concatenate([by_char[first], [SECTION]]).astype(np.int8)
        s[:1] = SECTION
        places = None
    else:
        raise ValueError(f"unknown unit {unit!r}")
    out = []
    for a, b in cuts(s, max_size, overlap):
        level = int(s[b])
        if unit == "bytes":
            start, end = int(np.searchsorted(places, a)), int(np.searchsorted(places, b))
        elif unit == "words":
            start = int(first[a])
            last = len(cp) if b == len(first) else int(first[b])
            end = start + len(text[start:last].rstrip(" \t\r\n"))
        else:
            start, end = a, b
        out.append((start, end, b - a, level))
    return out


def split_texts(df: DataFrame, key: str, text: str, limits: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per piece of each text larger than a limit: key, limit_id, piece_no, start_at, end_at, size, cut_at[, piece].

    Positions are code points from 0. ``limits`` (limit_id, unit, max_size, overlap) has at most MAX_LIMITS rows.
    """
    rows = limits.select("limit_id", "unit", "max_size", "overlap").limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"over {MAX_LIMITS} limits")
    rules = [(r["limit_id"], r["unit"], int(r["max_size"]), int(r["overlap"] or 0)) for r in rows if r["max_size"] is not None]
    least = min((m if u != "bytes" else m // 4 for _, u, m, _ in rules), default=0)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, limit_id string, piece_no int, start_at int, end_at int, size int, cut_at string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "limit_id", "piece_no", "start_at", "end_at", "size", "cut_at", *(["piece"] if with_text else [])]
        for batch in batches:
            found = []
            for k, t in zip(batch["_key"], batch["_text"]):
                known: dict = {}
                for limit_id, unit, most, shared in rules:
                    for i, (a, b, size, level) in enumerate(pieces(t, unit, most, shared, known)):
                        row = (k, limit_id, i, a, b, size, KINDS[max(level, 0)])
                        found.append((*row, t[a:b]) if with_text else row)
            yield pd.DataFrame(found, columns=names)

    return (
        df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
        .where(F.col("_text").isNotNull() & (F.length("_text") > least))
        .mapInPandas(run, schema + (", piece string" if with_text else ""))
    )
