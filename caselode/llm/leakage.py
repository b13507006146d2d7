"""Evaluation passages inside training texts (problem 7).

Texts become words: stretches of letters and digits of the canonical form, lower case. Five-word grams of the items
are counted over the whole corpus, which is read once per block of items; of every twelve-word window of an item the
rarest gram becomes a seed, so any text that holds twelve consecutive words of an item holds a seed of it, and texts
that share just stock phrases rarely do. A text is joined to the items whose seeds it holds where it lies, so no text is
shuffled; each candidate is scored by Smith-Waterman alignment of the item's words against the text's words
around the seeds, and its longest unbroken run is measured.

Edited and paraphrased copies need not share any five words. With ``edited`` a second kind of seed finds them: pairs
of words at a distance of one or two, in the item and in the text. An alignment worth at least half of an item of L
words (score 2 x matches - edits >= L) has at least L / 2 - 1 neighbouring matches with at most one edit between, each
of which is such a pair in both texts. So a text is a candidate only if it holds that many of the item's pairs, and
holds one of the item's rarest pairs (all but the L / 2 - 2 that stand in most items): no such copy is lost.

Items are the stated query set: they are worked off in blocks of BLOCK_ITEMS, so what goes to every task is
bounded whatever their number. Nothing about documents goes to the driver but counts of item grams.

Defined results: null and empty texts and items hold nothing; items of fewer than twelve words can't be found
by run (five-word windows still seed their alignment); repeated documents and items are reported each, for every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from caselode.llm.canonical import canonical
from caselode.session import cut_lineage

GRAM = 5
WINDOW = 12
BLOCK_ITEMS = 20_000
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return _WORD.findall(canonical(text).lower())


def gram_keys(ids: np.ndarray) -> np.ndarray:
    """Key of the gram at each position; 0 where it holds a word no item has."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    key, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for k in range(GRAM):
        part = ids[k : k + n]
        key = key * _BASE + part.astype(np.uint64)
        known &= part > 0
    return np.where(known, (key | np.uint64(1)).astype(np.int64), 0)


def choose_seeds(keys: np.ndarray, counts: dict[int, int]) -> list[int]:
    """Positions of the grams that seed an item: of each window the rarest; one already chosen serves again if as rare."""
    n_words = len(keys) + GRAM - 1
    span = max(1, min(WINDOW, n_words) - GRAM + 1)
    seen = [counts.get(int(k), 0) for k in keys]
    chosen: set[int] = set()
    for start in range(0, max(1, len(keys) - span + 1)):
        window = range(start, min(start + span, len(keys)))
        best = min(window, key=lambda p: (seen[p], p not in chosen, -p), default=None)
        if best is not None:
            chosen.add(best)
    return sorted(chosen)


def pair_keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs of known words at a distance of one or two, and the position of each pair's first word."""
    keys, places = [], []
    for step in (1, 2):
        a, b = ids[:-step], ids[step:]
        at = np.flatnonzero((a > 0) & (b > 0))
        keys.append((a[at].astype(np.uint64) * _BASE + b[at].astype(np.uint64)).astype(np.int64))
        places.append(at)
    return np.concatenate(keys), np.concatenate(places)


def pairs_needed(n_words: int) -> int:
    """How many of an item's pairs any text holds that is worth half of the item."""
    return max(1, -(-n_words // 2) - 1)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(best local alignment score, end of it in the text, longest run of equal words)."""
    n = len(text)
    at = np.arange(n + 1)
    above, run = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    best = end = longest = 0
    for word in item:
        same = text == word
        diagonal = above[:-1] + np.where(same, MATCH, MISMATCH)
        row = np.zeros(n + 1, dtype=np.int64)
        row[1:] = np.maximum(np.maximum(diagonal, above[1:] + GAP), 0)
        row = np.maximum.accumulate(row - GAP * at) + GAP * at  # gaps along the text
        run = np.concatenate([[0], np.where(same, run[:-1] + 1, 0)])
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        longest = max(longest, int(run.max()))
        above = row
    return best, end, longest


# ASCII characters that are neither letter nor digit become blanks; bytes of other characters stay
_BREAKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


class _Lookup(dict):
    """Token bytes to word id; tokens seen for the first time are parted into words where they hold other signs."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__(known)
        self.own, self.several = known, set()

    def __missing__(self, token: bytes):
        if len(self) > 500_000:
            self.clear()
            self.update(self.own)
        if token.isascii():
            found = 0
        else:
            ids = tuple(self.own.get(w.encode(), 0) for w in _WORD.findall(token.decode("utf-8", "replace")))
            found = ids[0] if len(ids) == 1 else ids
            if len(ids) != 1:
                self.several.add(token)
        self[token] = found
        return found

    def __reduce__(self):
        return _Lookup, (self.own,)


class ItemBlock:
    """Words, grams and seeds of one block of items; small, and sent to every task."""

    def __init__(self, items: list[tuple[object, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids = {}
        for key, text in items:
            self.ids[key] = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], dtype=np.int64)
        self.keys = {k: gram_keys(v) for k, v in self.ids.items()}
        every = [v for v in self.keys.values() if len(v)]
        self.grams = np.unique(np.concatenate(every)) if every else np.zeros(0, dtype=np.int64)
        self.lookup = _Lookup({w.encode(): i for w, i in self.vocabulary.items()})
        self.names = list(self.ids)
        self.needed = np.array([pairs_needed(len(v)) for v in self.ids.values()], dtype=np.int64)
        self._index_pairs()

    def _index_pairs(self) -> None:
        """For each pair the items that hold it: all of them, and those it is one of the rarest pairs of."""
        own = [np.unique(pair_keys(v)[0], return_counts=True) for v in self.ids.values()]
        sizes = np.array([len(k) for k, _ in own], dtype=np.int64)
        none = np.zeros(0, dtype=np.int64)
        flat = np.concatenate([k for k, _ in own]) if own else none
        times = np.concatenate([n for _, n in own]) if own else none
        items = np.repeat(np.arange(len(own)), sizes)
        self.pairs, place, spread = np.unique(flat, return_inverse=True, return_counts=True)
        rare = np.zeros(len(flat), dtype=bool)
        start = 0
        for size, needed in zip(sizes, self.needed):
            # the pairs that stand in most items are left out as long as a text can't do with them alone
            common = np.argsort(-spread[place[start : start + size]], kind="stable")
            rare[start + common[np.cumsum(times[start + common]) >= needed]] = True
            start += size
        order = np.argsort(place, kind="stable")
        self.holders, self.rare, self.times = items[order], rare[order], times[order]
        self.bounds = np.concatenate([[0], np.cumsum(spread)]).astype(np.int64)

    def near(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first, last position) of the items of which a text holds enough pairs."""
        keys, at = pair_keys(ids)
        hit = _hits(keys, self.pairs)
        if not len(hit):
            return []
        keys, at = keys[hit], at[hit]
        held, first = np.unique(keys, return_index=True)
        slots = np.searchsorted(self.pairs, held)
        sizes = self.bounds[slots + 1] - self.bounds[slots]
        rows = np.repeat(self.bounds[slots] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        who = self.holders[rows]
        counts = np.bincount(who, weights=self.times[rows], minlength=len(self.names))
        seeded = np.bincount(who[self.rare[rows]], minlength=len(self.names)) > 0
        found = np.flatnonzero(seeded & (counts >= self.needed))
        out = []
        for item in found:
            mine = np.isin(keys, np.repeat(held, sizes)[who == item])
            out.append((int(item), int(at[mine].min()), int(at[mine].max())))
        return out

    def of(self, text: str) -> np.ndarray:
        """Word ids of a text; 0 for words no item has."""
        tokens = canonical(text).lower().encode("utf-8", "replace").translate(_BREAKS).split()
        ids = list(map(self.lookup.__getitem__, tokens))
        if not self.lookup.several.isdisjoint(tokens):
            ids = [i for found in ids for i in (found if isinstance(found, tuple) else (found,))]
        return np.array(ids, dtype=np.int64)


def _hits(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions whose key is wanted (sorted)."""
    if not len(keys) or not len(wanted):
        return np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return np.flatnonzero((wanted[at] == keys) & (keys != 0))


def _passages(docs: DataFrame, block, doc_type: str, edited: bool) -> DataFrame:
    """(doc_id, ids, grams, places, near): texts that may hold an item, as word ids, with their item grams and where
    they stand, and the items of which they hold enough pairs. One reading of the corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = block.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch["_doc"], batch["_text"]):
                ids = b.of(text)
                keys = gram_keys(ids)
                at = _hits(keys, b.grams)
                near = b.near(ids) if edited else []
                if len(at) or near:
                    rows.append((doc, ids.astype(np.int32), keys[at], at.astype(np.int32), np.array(near, dtype=np.int32).ravel()))
            yield pd.DataFrame(rows, columns=["doc_id", "ids", "grams", "places", "near"])

    return cut_lineage(docs.mapInPandas(run, f"doc_id {doc_type}, ids array<int>, grams array<long>, places array<int>, near array<int>"))


def _block_alignments(docs: DataFrame, items: list[tuple[object, str]], item_type: str, doc_type: str, edited: bool) -> DataFrame:
    spark = docs.sparkSession
    made = ItemBlock(items)
    block = spark.sparkContext.broadcast(made)
    passages = _passages(docs, block, doc_type, edited)
    counted = passages.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    counts = {r["gram"]: r["n"] for r in counted.collect()}  # at most the grams of one block of items
    seeds: dict[int, list[int]] = {}
    for item, keys in enumerate(made.keys.values()):
        for p in choose_seeds(keys, counts) if len(keys) else []:
            seeds.setdefault(int(keys[p]), []).append(item)
    sent = spark.sparkContext.broadcast(seeds)  # at most a seed per window of BLOCK_ITEMS items

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b, seeds = block.value, sent.value
        for batch in batches:
            rows = []
            for doc, ids, grams, places, near in zip(batch["doc_id"], batch["ids"], batch["grams"], batch["places"], batch["near"]):
                ids = np.asarray(ids, dtype=np.int64)
                found: dict[int, list] = {int(item): [0, int(a), int(z)] for item, a, z in np.asarray(near).reshape(-1, 3)}
                met: set[tuple[int, int]] = set()
                for gram, at in zip(grams, places):
                    for item in seeds.get(int(gram), ()):
                        hit = found.setdefault(item, [0, int(at), int(at)])
                        hit[0] += (gram, item) not in met
                        met.add((gram, item))
                        hit[1], hit[2] = min(hit[1], int(at)), max(hit[2], int(at))
                for item, (n, a, z) in found.items():
                    words_of = b.ids[b.names[item]]
                    start = max(0, a - 2 * len(words_of))
                    score, end, run = align(words_of, ids[start : z + GRAM + 2 * len(words_of)])
                    rows.append((doc, b.names[item], n, score, score / (MATCH * len(words_of)), start + end, run))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "seeds", "score", "share", "end_word", "longest_run"])

    schema = f"doc_id {doc_type}, item_id {item_type}, seeds long, score int, share double, end_word int, longest_run int"
    return passages.mapInPandas(scored, schema)


def leak_alignments(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, edited: bool = False) -> DataFrame:
    """One row per document and item that share a seed: seeds, score, share of the item's perfect score, end_word, longest_run.

    With ``edited`` also every document worth at least half of an item, whatever it shares. Rows with a null key or
    text hold nothing.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    src = docs.select(F.col(doc_key).alias("_doc"), F.col(doc_text).alias("_text")).where("_doc is not null and _text is not null")
    stated = items.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).where("k is not null and t is not null")
    blocks = -(-stated.count() // BLOCK_ITEMS) or 1
    found = None
    for i in range(blocks):
        rows = [(r["k"], r["t"]) for r in stated.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == i).collect()]
        part = _block_alignments(src, rows, kind(items, item_key), kind(docs, doc_key), edited)
        found = part if found is None else found.unionByName(part)
    return found
