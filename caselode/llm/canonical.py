"""One form for texts a reader cannot tell apart (problem 2).

A longest-match transducer over grapheme clusters, compiled once per worker. Its raw keys are single characters and
sequences ("\\r\\n"); they lead to decomposed images without characters that take no space. Its cluster keys are a base
and its marks, in canonical order, or the letters of a Korean syllable; they form a trie whose nodes hold the composed
letter. A text is read once: raw keys are replaced by longest match, marks are put in order, and the trie is followed
as far as the cluster goes; a mark without an edge is left behind its letter. The mapping is precomputed from
Unicode's own data and the fixed look-alike table below. Two images for one cluster key raise an error, and every
image must be its own image, so the map is idempotent; what comes out is composed (NFC). Only stretches that hold a
character outside ASCII (or a control character) are looked at, and their images are remembered per worker.

Kept apart: letter case, accents, digits, punctuation, superscripts, the number of blanks, line breaks; letters of
another weight or style (mathematical bold, italic, script), which a reader can tell from plain ones, and letters of
other alphabets whose shape is close but not the same (Greek alpha, kappa).
Made one: width forms, typographic ligatures, composition, the order of marks, characters without width,
kinds of blank (a tab is a blank), kinds of line break, letters and signs of equal shape in other alphabets.

Defined results: null stays null; a text of nothing but characters without width becomes empty; a text in
canonical form is returned as it is (the map is idempotent); length is not bounded.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from caselode.operators.skew import broadcast_if_small, salt_of, salted_join
from caselode.session import cut_lineage

# Characters whose usual shape equals that of the Latin letter or ASCII sign below them.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХҮԚԜӀаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXYQWIaesijopcyxhdqwl")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονρϲϳ", "ABEZHIKMNOPTYXCJovpcj")
ARMENIAN = ("ՕՍՏԼօոսհցզ", "OUSLonuhgq")
CHEROKEE = ("ᎠᎢᎪᎫᎬᎳᎷᎻᏀᏃᏢᏚᏙᏞᏟᏦ", "DTAJEWMHGZPSVLCK")
COPTIC = ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲟⲣⲥ", "HIKMNOPCTXopc")
LISU = ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU")
LATIN = ("ɡɑᴄᴏꜱᴠᴡᴢ", "gacosvwz")
ROMAN = ("ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "IVXLCDMivxlcdm")
SIGNS = ("‐‑∕⁄∣∶꞉ǃ‚․;ʼµ·", "--//|::!,.;’μ·")
# End of fixed values.

SEQUENCES = {"\r\n": "\n"}
_DECOMPOSED = (range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0200))
_ZERO_WIDTH_EXTRA = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0"


def _raw_single(ch: str) -> str | None:
    """Image of one character by the first rule that knows it, or None. Marks are no business of this table."""
    cat, cp = unicodedata.category(ch), ord(ch)
    if cat == "Cf" or ch in _ZERO_WIDTH_EXTRA or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
        return ""
    if cat == "Cc" and ch not in "\t\n\r\v\f\x85":
        return ""
    if cat == "Zs" or ch == "\t":
        return " "
    if cat in ("Zl", "Zp") or ch in "\x85\r\v\f":
        return "\n"
    tag = unicodedata.decomposition(ch).split(" ", 1)[0]
    if tag in ("<wide>", "<narrow>"):
        return unicodedata.normalize("NFKC", ch)
    if 0xFB00 <= cp <= 0xFB06:
        return unicodedata.normalize("NFKC", ch).replace("ſ", "s")
    return None


def _build_singles() -> dict[str, str]:
    """The conflict-checked map of single characters; images are closed under the map."""
    table: dict[str, str] = {}

    def put(key: str, image: str) -> None:
        if table.setdefault(key, image) != image:
            raise ValueError(f"conflicting images for U+{ord(key):04X}: {table[key]!r} and {image!r}")

    for cp in itertools.chain(range(0x20), range(0x7F, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x10000), range(0x110BD, 0x110BE), range(0x1D173, 0x1D17B), range(0xE0000, 0xE0200)):
        ch = chr(cp)
        if ch != "\n" and (image := _raw_single(ch)) is not None:
            put(ch, image)
    for shapes, letters in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, COPTIC, LISU, LATIN, ROMAN, SIGNS):
        for ch, image in zip(shapes, letters, strict=True):
            put(ch, image)
    for key, image in list(table.items()):  # close: the image of an image is itself
        for _ in range(3):
            again = "".join(table.get(c, c) for c in image)
            if again == image:
                break
            image = again
        if any(c in table and table[c] != c for c in image):
            raise ValueError(f"no fixed point for U+{ord(key):04X}")
        table[key] = image
    return table


@functools.cache
def singles() -> dict[str, str]:
    return _build_singles()


class Transducer:
    """The compiled map. ``raw``: character or sequence to decomposed image; ``trie``: cluster keys to composed letters."""

    def __init__(self) -> None:
        table = singles()
        nfd, nfc = functools.partial(unicodedata.normalize, "NFD"), functools.partial(unicodedata.normalize, "NFC")
        image = lambda text: nfd("".join(table.get(c, c) for c in nfd(text)))
        self.raw: dict[str, str] = {}
        self.trie: dict[str, dict] = {}
        self.letters = 0
        for cp in itertools.chain(range(0x80), *_DECOMPOSED):
            ch = chr(cp)
            if (found := image(ch)) != ch:
                self.raw[ch] = found
        self.raw |= SEQUENCES
        self.longest = max(map(len, self.raw))
        for cp in itertools.chain(*_DECOMPOSED):
            key = nfd(chr(cp))
            if len(key) > 1 and nfc(key) == chr(cp) and image(key) == key:
                self._put(key, chr(cp))
        for first, middle in itertools.product(range(19), range(21)):
            syllable = 0xAC00 + (first * 21 + middle) * 28
            node = self._put(chr(0x1100 + first) + chr(0x1161 + middle), chr(syllable))
            for last in range(1, 28):
                self._put(chr(0x1100 + first) + chr(0x1161 + middle) + chr(0x11A7 + last), chr(syllable + last))
            self.trie[chr(syllable)] = node
        for ch, found in self.raw.items():
            if self.apply(once := self.apply(ch)) != once:
                raise ValueError(f"no fixed point for {ascii(ch)}: {once!r}")

    def _put(self, key: str, letter: str) -> dict:
        """The node of a cluster key; ``""`` holds its letter."""
        node = self.trie.setdefault(key[0], {"": key[0]})
        for mark in key[1:]:
            node = node.setdefault(mark, {})
        if node.setdefault("", letter) != letter:
            raise ValueError(f"conflicting letters for {ascii(key)}: {node['']!r} and {letter!r}")
        self.letters += 1
        return node

    def _decomposed(self, text: str) -> list[str]:
        """Images of the longest raw keys, with the marks of each cluster in canonical order."""
        out: list[str] = []
        at, n = 0, len(text)
        while at < n:
            for size in range(min(self.longest, n - at), 0, -1):
                found = self.raw.get(text[at : at + size])
                if found is not None:
                    break
            out.extend(text[at] if found is None else found)
            at += size
        order = [unicodedata.combining(c) for c in out]
        start = 0
        for end in range(1, len(out) + 1):
            if end == len(out) or not order[end]:
                first = start + (order[start] == 0)
                if end - first > 1:
                    out[first:end] = [c for _, c in sorted(zip(order[first:end], out[first:end]), key=lambda x: x[0])]
                start = end
        return out

    def apply(self, text: str) -> str:
        out: list[str] = []
        node, behind, last = {"": ""}, [], 0
        for c in self._decomposed(text):
            rank = unicodedata.combining(c)
            below = node.get(c) if not behind or last < rank else None
            if below is not None and "" in below:
                node = below
            elif rank:
                behind.append(c)
                last = rank
            else:
                out += [node[""], *behind]
                node, behind, last = self.trie.get(c) or {"": c}, [], 0
        return "".join([*out, node[""], *behind])


@functools.cache
def transducer() -> Transducer:
    return Transducer()


@functools.lru_cache(maxsize=200_000)
def _stretch(part: str) -> str:
    """Image of one short stretch."""
    return transducer().apply(part)


_PLAIN = re.compile(r"[\x00-\x08\t\r\x0b-\x1f\x7f]")
_STRETCH = re.compile(r"[\x21-\x7e]?(?:\r\n|[^\n\x20-\x7e])+")


def canonical(text: str) -> str:
    """The one form of a text."""
    if text.isascii() and not _PLAIN.search(text):
        return text
    return _STRETCH.sub(lambda m: _stretch(m.group(0)), text)


@F.pandas_udf(T.StringType())
def canonical_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column function: the one form of each text; null for null."""
    for part in parts:
        yield part.map(canonical, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def canonical_digest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column function: 128-bit digest of the one form, so that no text has to be shuffled."""
    for part in parts:
        yield part.map(lambda t: hashlib.blake2b(canonical(t).encode("utf-8", "surrogatepass"), digest_size=16).digest(), na_action="ignore")


ROWS_PER_PART = 50_000


def lookalike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(class_id, form, key, parts): each row whose text has another stored form with the same canonical form.

    A class is a canonical form, ``form`` the stored one (both as 128-bit digests: no text travels). Stored forms are
    counted first, so a text copied into a third of all rows is one form; ``parts`` says into how many parts the
    rows of a form are to be dealt. Null texts and null keys are in no class.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.unhex(F.md5(F.col(text))).alias("form"), canonical_digest(F.col(text)).alias("class_id")
    )
    rows = cut_lineage(rows)
    forms = cut_lineage(rows.groupBy("class_id", "form").agg(F.ceil(F.count("*") / ROWS_PER_PART).cast("int").alias("parts")))
    several = forms.groupBy("class_id").agg(F.count("*").alias("forms")).where("forms > 1").select("class_id")
    some = cut_lineage(forms.join(several, "class_id", "left_semi"))
    told = some.select("form", "parts")
    small = broadcast_if_small(told)
    members = rows.join(small, "form") if small is not told else salted_join(rows, told, ["form"], ["key"])
    return members.select("class_id", "form", "key", "parts")


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b): rows whose texts are stored differently but have one canonical form, from the rows of the classes.

    Pairs of forms are found first, dealt over salts; rows meet only rows of a paired form, and just the forms with
    very many rows are dealt over parts.
    """
    members = cut_lineage(lookalike_classes(df, key, text))
    forms = members.select("class_id", "form", "parts").distinct()
    other = forms.select("class_id", F.col("form").alias("form_b"), F.col("parts").alias("parts_b"))
    links = salted_join(forms, other, ["class_id"], ["form"]).where("form < form_b")
    deal = lambda n: F.explode(F.sequence(F.lit(0), n - 1)).alias("part")
    dealt = members.select("form", F.pmod(salt_of("key", salts=1 << 30), F.col("parts")).alias("part"), "key")
    one = dealt.join(links.select("form", "form_b", "parts_b", deal(F.col("parts"))), ["form", "part"])
    one = one.select(F.col("key").alias("one"), F.col("form_b").alias("form"), deal(F.col("parts_b")))
    both = dealt.join(one, ["form", "part"])
    return both.select(F.least("one", "key").alias("key_a"), F.greatest("one", "key").alias("key_b")).where("key_a < key_b")
