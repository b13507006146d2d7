"""Per-document text statistics and how far they lie from prose (problem 8).

Statistics of every text (whole, never a prefix) are computed in Arrow batches. The language is the one whose
common words cover most of the text; the lang column is not trusted. Per language, centre and covariance of
prose are estimated robustly from all documents: medians and median deviations first, then four concentration
steps that keep the documents within the distance that prose rarely exceeds, all as Spark aggregates, so only
sums (languages x statistics squared) go to the driver. The squared Mahalanobis distance is the sum of one
contribution per statistic; these are reported. The distance beyond which a text is not prose is read from
labelled documents: the cut with the best F1 over a bounded sample of labels.

Defined results: null, empty and blank texts have word_count 0, null statistics and null distance, and are
no case; texts without any common word are compared with the prose of all languages together; a language with
too few documents for a covariance uses that of all languages too.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from caselode.operators.sampling import bounded_sample
from caselode.session import cut_lineage

STATS = (
    "log_words", "mean_word_len", "symbol_share", "digit_share", "punct_line_share", "common_share",
    "told_share", "marker_share", "short_item_share", "log_line_words", "distinct_share", "long_share",
)
MAX_LABELS = 20_000
MAX_COMMON_WORDS = 50_000
MIN_DOCS = 200
RIDGE = 0.006
DEFAULT_CUT = 50.0
ANY = "any"

_ENDS = tuple(".!?…:;\"”»)'’。")
_MARKER = re.compile(r"\s*(?:[-–—•·*→+]+\s|o\s|\(?\d{1,3}[.)]\s|#\d|\[.?\]\s|[A-Za-z][.)]\s)")
_LABELLED = re.compile(r"[^.!?:]{1,40}:\s*\S+(?:\s\S+){0,2}$")
_NUMBERS = re.compile(r"\s+[\d.,]+\s")
_CELL_ENDS = re.compile(r"[\t|;]| {2,}|\",")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ITEM_SPLIT = re.compile(r"[,;•·|\t\n]")
_SPAN = 24
_RATE = 0.2
_PRIOR = 3  # words of ordinary prose added to a text, so that single sentences aren't judged by one word


@functools.lru_cache(maxsize=4)
def _united(sets: tuple[frozenset[str], ...]) -> frozenset[str]:
    return frozenset().union(*sets)


def _in_cells(line: str) -> bool:
    """Does a line look like a row of a table, or a named value? Long lines must be dense with separators."""
    parted = (
        "\t" in line or line.count("|") > 1 or line.count(";") > 1 or '","' in line or "   " in line.strip() or " = " in line or "..." in line
        or (":" in line[1:42] and _LABELLED.match(line)) or _NUMBERS.match(line)
    )
    return bool(parted) and (len(line) <= 160 or len(_CELL_ENDS.findall(line)) * 40 >= len(line))


def text_stats(text: str, common: dict[str, frozenset[str]]) -> tuple[str, int, tuple[float, ...]] | None:
    """(language, word count, statistics) of a text; None where there is nothing but blanks."""
    tokens = text.split()
    if not tokens:
        return None
    n = len(tokens)
    words = _WORDS.findall(text.lower())
    counts = Counter(words)
    known = {lang: sum(counts[w] for w in of if w in counts) for lang, of in common.items()}
    lang = max(sorted(known), key=known.get, default=ANY)
    covered = known.get(lang, 0)
    every = _united(tuple(common.values()))
    if not covered:
        lang = ANY
    chars = sum(map(len, tokens))
    letters = sum(map(len, words))
    digits = sum(map(text.count, "0123456789"))
    lines = [line for line in text.splitlines() if line.strip()]
    ended = sum(line.rstrip().endswith(_ENDS) for line in lines)
    marked = sum(len(line) for line in lines if _MARKER.match(line) or _in_cells(line))
    items = [part for part in _ITEM_SPLIT.split(text) if part and not part.isspace()]
    short = sum(len(part) for part in items if len(part.split(None, 5)) <= 5)
    size = sum(map(len, lines))
    # words in the order of the text: in prose, about every third is a common word of some language
    hits = np.fromiter(map(every.__contains__, words), dtype=np.int64, count=len(words))
    sums = np.concatenate([[0], np.cumsum(hits)])
    span = min(_SPAN, len(words))
    rates = (sums[span:] - sums[: len(sums) - span] + _PRIOR * 0.3) / (span + _PRIOR) if span else np.zeros(1)
    told = float(np.minimum(rates / _RATE, 1.0).mean())
    grams = list(zip(tokens, tokens[1:], tokens[2:]))
    distinct = len(set(grams)) / len(grams) if grams else 1.0
    stats = (
        np.log1p(n),
        min((letters + 5.0 * _PRIOR) / (len(words) + _PRIOR), 20.0),
        max(chars - letters - digits, 0) / chars,
        digits / chars,
        ended / max(len(lines), 1),
        covered / max(len(words), 1),
        told * min(letters / chars / 0.7, 1.0),
        marked / max(size, 1),
        min(short / max(size, 1), 1.0) if len(items) > 4 else 0.0,
        np.log1p(n / max(len(lines), 1)),
        distinct,
        sum(len(w) for w in tokens if len(w) > 25) / chars,
    )
    return lang, n, tuple(map(float, stats))


def _common_words(words: DataFrame) -> dict[str, frozenset[str]]:
    rows = words.select("lang", "word").where("lang is not null and word is not null").limit(MAX_COMMON_WORDS + 1).collect()
    if len(rows) > MAX_COMMON_WORDS:
        raise ValueError(f"over {MAX_COMMON_WORDS} common words")
    found: dict[str, set[str]] = {}
    for r in rows:
        found.setdefault(r["lang"], set()).add(r["word"].lower())
    return {lang: frozenset(of) for lang, of in found.items()}


def document_stats(docs: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """(doc_id, language, word_count, stats array<double>); blank and null texts have null language and stats."""
    common = _common_words(words)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["_key"], batch["_text"]):
                found = text_stats(t, common) if isinstance(t, str) else None
                rows.append((k, *found) if found else (k, None, 0, None))
            yield pd.DataFrame(rows, columns=["doc_id", "language", "word_count", "stats"])

    src = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return src.mapInPandas(run, f"doc_id {kind}, language string, word_count long, stats array<double>")


class ProseModel:
    """Centre and inverse covariance of prose by language, and the distance from which on a text is no prose."""

    def __init__(self) -> None:
        self.centre: dict[str, np.ndarray] = {}
        self.inverse: dict[str, np.ndarray] = {}
        self.cut = DEFAULT_CUT

    def _by_language(self, language: np.ndarray):
        for lang in np.unique(language.astype(str)):
            yield language == lang, lang if lang in self.centre else ANY

    def contributions(self, language: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Per text and statistic; a row's sum is its squared distance."""
        out = np.zeros_like(x)
        for mask, lang in self._by_language(language):
            off = x[mask] - self.centre[lang]
            out[mask] = off * (off @ self.inverse[lang])
        return out

    def distance(self, language: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.contributions(language, x).sum(axis=1)


def best_cut(distance: np.ndarray, odd: np.ndarray) -> float:
    """The distance that parts labelled prose from the rest with the best F1; DEFAULT_CUT without both kinds."""
    if not odd.any() or odd.all():
        return DEFAULT_CUT
    order = np.argsort(-distance, kind="stable")
    d, hits = distance[order], np.cumsum(odd[order])
    f1 = 2 * hits / (np.arange(1, len(d) + 1) + odd.sum())
    at = int(f1.argmax())
    return float(np.sqrt(d[at] * d[min(at + 1, len(d) - 1)]))  # between the two, on the scale of ratios


def _medians(stats: DataFrame) -> ProseModel:
    """A first, diagonal model from medians and median deviations."""
    model, n = ProseModel(), len(STATS)
    x = [F.col("stats")[i] for i in range(n)]

    def by_language(df: DataFrame, columns: list) -> dict[str, list[float]]:
        aggs = [F.percentile_approx(c, 0.5, 1000).alias(f"m{i}") for i, c in enumerate(columns)]
        one = df.groupBy("language").agg(F.count("*").alias("docs"), *aggs).collect()
        every = df.agg(*aggs).collect()
        found = {r["language"]: [r[f"m{i}"] for i in range(n)] for r in one if r["docs"] >= MIN_DOCS and r["language"] != ANY}
        return found | {ANY: [every[0][f"m{i}"] or 0.0 for i in range(n)]}

    centre = by_language(stats, x)
    pick = F.coalesce(
        *[F.when(F.col("language") == lang, F.array(*map(F.lit, c))) for lang, c in centre.items() if lang != ANY],
        F.array(*map(F.lit, centre[ANY])),
    )
    off = stats.withColumn("centre", pick)
    spread = by_language(off, [F.abs(F.col("stats")[i] - F.col("centre")[i]) for i in range(n)])
    for lang, c in centre.items():
        model.centre[lang] = np.array(c)
        scale = 1.4826 * np.array(spread.get(lang, spread[ANY])) + 0.05
        model.inverse[lang] = np.diag(1 / scale**2)
    return model


def _refit(stats: DataFrame, last: ProseModel) -> ProseModel:
    """Mean and covariance of the texts that the last model takes for prose. Sums are formed where the data are."""
    n = len(STATS)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            language, x = batch["language"].to_numpy().astype(str), np.vstack(batch["stats"].to_numpy())
            near = last.distance(language, x) < last.cut
            for lang in np.unique(language[near]):
                part = x[near & (language == lang)]
                row = np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
                for name in {lang, ANY}:
                    total[name] = total.get(name, 0) + row
        for lang, row in total.items():
            yield pd.DataFrame({"language": lang, "at": np.arange(len(row)), "value": row})

    rows = (
        stats.select("language", "stats")
        .mapInPandas(sums, "language string, at int, value double")
        .groupBy("language", "at")
        .agg(F.sum("value").alias("value"))
        .collect()
    )  # languages x (1 + statistics + statistics squared) rows
    model = ProseModel()
    model.cut = last.cut
    table: dict[str, np.ndarray] = {}
    for r in rows:
        table.setdefault(r["language"], np.zeros(1 + n + n * n))[r["at"]] = r["value"]
    for lang, row in table.items():
        size = row[0]
        if size < (MIN_DOCS if lang != ANY else 2):
            continue
        mean = row[1 : n + 1] / size
        cov = row[n + 1 :].reshape(n, n) / size - np.outer(mean, mean)
        model.centre[lang], model.inverse[lang] = mean, np.linalg.inv(cov + RIDGE * np.eye(n))
    return model if ANY in model.centre else last


def fit_prose(stats: DataFrame, labels: DataFrame, label_key: str = "doc_id", form: str = "form", rounds: int = 4) -> ProseModel:
    """The model after ``rounds`` concentration steps; at most MAX_LABELS labelled texts set the cut."""
    told = stats.where("stats is not null")
    few = labels.select(F.col(label_key).alias("doc_id"), (F.col(form) != "prose").alias("odd")).where("doc_id is not null and odd is not null")
    few = bounded_sample(few, "doc_id", MAX_LABELS)
    rows = told.join(F.broadcast(few), "doc_id").select("language", "stats", "odd").collect()
    language = np.array([r["language"] for r in rows], dtype=object).astype(str)
    x = np.array([r["stats"] for r in rows], dtype=float).reshape(-1, len(STATS))
    odd = np.array([r["odd"] for r in rows], dtype=bool)
    model = _medians(told)
    for _ in range(rounds):
        model.cut = best_cut(model.distance(language, x), odd)
        model = _refit(told, model)
    model.cut = best_cut(model.distance(language, x), odd)
    return model


def prose_report(docs: DataFrame, key: str, text: str, words: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: word_count, language, every statistic, its contribution (c_...), distance, is_prose."""
    stats = cut_lineage(document_stats(docs, key, text, words))
    model = fit_prose(stats, labels)
    kind = docs.schema[key].dataType.simpleString()
    names = [*STATS, *(f"c_{s}" for s in STATS), "distance"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            there = batch["stats"].notna().to_numpy()
            table = np.full((len(batch), len(names)), np.nan)
            if there.any():
                x = np.vstack(batch["stats"].to_numpy()[there])
                parts = model.contributions(batch["language"].to_numpy()[there].astype(str), x)
                table[there] = np.hstack([x, parts, parts.sum(1, keepdims=True)])
            out = pd.DataFrame(table, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            out.insert(1, "language", batch["language"].to_numpy())
            out.insert(2, "word_count", batch["word_count"].to_numpy())
            yield out

    schema = f"doc_id {kind}, language string, word_count long, " + ", ".join(f"{c} double" for c in names)
    found = stats.mapInPandas(run, schema)
    return found.select(
        "doc_id", "language", "word_count", *[F.nanvl(c, F.lit(None)).alias(c) for c in names]
    ).withColumn("is_prose", F.col("distance") < model.cut)
