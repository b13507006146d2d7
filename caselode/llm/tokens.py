"""Encoding texts by a public byte-level BPE vocabulary (problem 6).

Speculate and verify. A text is parted into words by the vocabulary's pattern. For words not seen before,
greedy longest match proposes tokens; then all pairs of neighbouring tokens of the whole batch are tested at
once: undoing merges from the latest to the earliest on both sides of the border must never meet a pair that
the vocabulary would have joined earlier. A word whose pairs all pass is encoded as exact merging would; only
failing words are merged exactly. Words and their ids are remembered per worker in a bounded cache.

Defined results: empty and null texts give an empty list; strings that look like special tokens are ordinary
text; every other text, blanks and control characters included, decodes to itself (lone surrogates excepted,
which Spark strings can't hold).
"""

from __future__ import annotations

import base64
import heapq
import itertools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, functions as F, types as T

TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the pattern that parts texts into words for this family of vocabularies.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 400_000
LONG_WORD = 100


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids from a .tiktoken file; ids are merge ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def tokenizer_path(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, f"{name}.tiktoken")


class SpeculativeBpe:
    """Encoder over merge ranks. ``exact`` counts the words that needed exact merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = WORD_PATTERN):
        self.ranks, self.words = ranks, regex.compile(pattern)
        # how long a token that starts with two given bytes can be
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > 1 and len(token) > self.reach.get(token[:2], 1):
                self.reach[token[:2]] = len(token)
        self.size = max(ranks.values()) + 1
        self.cache: dict[str, list[int]] = {}
        self.exact = self.seen = 0
        self._pair_tables()

    def __getstate__(self) -> dict:
        return {**self.__dict__, "words": self.words.pattern, "cache": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update({**state, "words": regex.compile(state["words"])})

    def _pair_tables(self) -> None:
        """For each token the two tokens it was merged from (itself, if a single byte), and all merges by pair."""
        left, right = np.arange(self.size), np.arange(self.size)
        keys, joined = [], []
        for token, rank in self.ranks.items():
            if len(token) > 1:
                parts = self._merged(token, rank)
                if len(parts) == 2:
                    left[rank], right[rank] = parts
                    keys.append(parts[0] * self.size + parts[1])
                    joined.append(rank)
        # any pair whose bytes make up a token could be merged, whatever way that token is usually reached
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.left, self.right = left, right
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_ranks = np.array(joined, dtype=np.int64)[order]
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}

    def _merged(self, word: bytes, below: int | None = None) -> list[int]:
        """Exact merging: the neighbours of lowest rank first, leftmost on ties; ranks from ``below`` on don't count."""
        if len(word) > LONG_WORD and below is None:
            return self._merged_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        get, none = self.ranks.get, 1 << 60
        joins = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while joins:
            low = min(joins)
            if low == none or (below is not None and low >= below):
                break
            i = joins.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joins[i]
            if i < len(joins):
                joins[i] = get(parts[i] + parts[i + 1], none)
            if i:
                joins[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _merged_long(self, word: bytes) -> list[int]:
        """The same for long words, with a heap of joins over a linked list."""
        n, get = len(word), self.ranks.get
        end = list(range(1, n + 1))  # end of the part that starts here
        before, alive = list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if i >= 0 and j < n and (rank := get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != j or not alive[j] or end[j] != stop:
                continue  # one of the two has been joined since
            end[i], alive[j] = stop, False
            if stop < n:
                before[stop] = i
            offer(i)
            if i and before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out

    def _greedy(self, word: bytes) -> list[int]:
        out, at, n, get, reach = [], 0, len(word), self.ranks.get, self.reach.get
        while at < n:
            for end in range(min(n, at + reach(word[at : at + 2], 1)), at, -1):
                token = get(word[at:end])
                if token is not None:
                    out.append(token)
                    at = end
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return out

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.size)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair: would exact merging of the two tokens' bytes end in just these two?"""
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.zeros(len(a), dtype=bool)
        live = np.arange(len(a))
        bound = np.full(len(a), self.size, dtype=np.int64)  # merges across the border below this would have come first
        while len(live):
            ok = self._joined(a, b) >= bound
            live, a, b, bound = live[ok], a[ok], b[ok], bound[ok]
            a_single, b_single = self.left[a] == a, self.left[b] == b
            done = a_single & b_single
            good[live[done]] = True
            live, a, b, bound, a_single, b_single = (x[~done] for x in (live, a, b, bound, a_single, b_single))
            # undo the later merge of the two; on equal ranks the left one came first, so the right one is undone first
            undo_a = ~a_single & (b_single | (a > b))
            bound = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return good

    def learn(self, words: list[str]) -> None:
        """Encode words that are not in the cache."""
        raw = [w.encode("utf-8", "replace") for w in words]
        proposed = [[self.ranks[r]] if r in self.ranks else self._greedy(r) for r in raw]
        self.seen += len(words)
        sizes = np.array([len(p) for p in proposed], dtype=np.int64)
        flat = np.fromiter((t for p in proposed for t in p), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[:-1] == owner[1:]) if len(flat) > 1 else np.array([], dtype=np.int64)
        # many words share pairs: each distinct pair is tested once
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fits = self.compatible(pairs // self.size, pairs % self.size)[back] if len(pairs) else np.array([], dtype=bool)
        failing = set(owner[inner[~fits]].tolist())
        self.exact += len(failing)
        for i, w in enumerate(words):
            self.cache[w] = self._merged(raw[i]) if i in failing else proposed[i]

    def encode_parts(self, texts: list[str | None]) -> list[Iterator[int]]:
        """The ids of each text, as iterators over the cache."""
        parted = [self.words.findall(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        unknown = set().union(*parted).difference(self.cache)
        if unknown:
            self.learn(list(unknown))
        of = self.cache.__getitem__
        return [itertools.chain.from_iterable(map(of, words)) for words in parted]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        return [list(ids) for ids in self.encode_parts(texts)]


def encoder(name: str = "byte_bpe_50k", folder: str | None = None) -> Callable[[Column], Column]:
    """A column function text -> array<int>. The vocabulary file (a fixed 1 MB) is read on the driver, its pair tables are
    built there once and sent along; a worker keeps the encoder, and the words it has met, from task to task."""
    from pyspark.sql import SparkSession

    sent = SparkSession.active().sparkContext.broadcast(SpeculativeBpe(read_ranks(tokenizer_path(name, folder))))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = sent.value
        for part in parts:
            out = []
            texts = part.tolist()
            for at in range(0, len(texts), 256):
                few = bpe.encode_parts([t if isinstance(t, str) else None for t in texts[at : at + 256]])
                out.extend(np.fromiter(ids, dtype=np.int32) for ids in few)
            yield pd.Series(out, index=part.index, dtype=object)

    return encode
