import itertools
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from caselode.llm import canonical as c

SAME = [
    ("naïve", "naïve"), ("abc", "ａｂｃ"), ("a b", "a b"), ("a b", "a b"), ("ab", "a​b"), ("ab", "﻿a­b"),
    ("difficult", "diﬃcult"), ("co", "со"), ("Belähe", "Belӓhe"), ("T5", "Τ5"), ("5 µg", "5 μg"),
    ("a-b", "a‑b"), ("a\nb", "a\r\nb"), ("é", "e‍́"), ("a b", "a\tb"),
]
APART = [("a", "A"), ("naive", "naïve"), ("a b", "a  b"), ("10⁹", "109"), ("1", "l"), ("a.", "a!"), ("a-b", "a–b"), ("2.º", "2.°"), ("a b", "ab"), ("a\nb", "a b")]


def test_same_and_apart():
    for a, b in SAME:
        assert c.canonical(a) == c.canonical(b), (a, b)
    for a, b in APART:
        assert c.canonical(a) != c.canonical(b), (a, b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_idempotent_and_composed(text):
    once = c.canonical(text)
    assert c.canonical(once) == once
    assert unicodedata.is_normalized("NFC", once)


def test_map_is_closed():
    table = c.singles()
    assert all(table.get(ch, ch) == ch for image in table.values() for ch in image)


def test_cluster_and_sequence_keys():
    t = c.transducer()
    assert t.longest == 2 and t.raw["\r\n"] == "\n"
    # one cluster, written in different orders, composed or not, on a look-alike or a wide base, with a joiner inside
    for way in ("ệ", "e\u0323\u0302", "e\u0302\u0323", "\u1eb9\u0302", "ê\u0323", "\u0435\u0302\u0323", "\uff45\u200d\u0302\u0323"):
        assert c.canonical(way) == "ệ", ascii(way)
    node = t.trie["e"]["\u0323"]["\u0302"]
    assert node[""] == "ệ"
    # a mark without an edge stays behind its letter, and a later one still composes
    assert c.canonical("a\u0316\u0301") == c.canonical("á\u0316") == "á\u0316"
    assert c.canonical("\u1112\u1161\u11ab") == c.canonical("\ud558\u11ab") == "한"
    for ch in ("Å", "\u212b", "\uff21\u030a", "\u0410\u030a"):
        assert c.canonical(ch) == "Å"


def test_conflicts_are_refused():
    t = c.Transducer()
    with pytest.raises(ValueError):
        t._put("e\u0301", "x")


def test_classes(spark):
    texts = ["fever", "f\u0435ver", "fever", "cough", "fever\u200b", None]
    df = spark.createDataFrame(list(enumerate(texts)), "line_no long, note string")
    got = c.lookalike_classes(df, "line_no", "note").collect()
    assert sorted(r["key"] for r in got) == [0, 1, 2, 4] and len({bytes(r["class_id"]) for r in got}) == 1 and len({bytes(r["form"]) for r in got}) == 3


def test_hot_forms_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(c, "ROWS_PER_PART", 7)
    texts = ["hot text"] * 40 + ["hot\u00a0text"] * 9 + ["h\u043et text"] * 2 + ["other"]
    df = spark.createDataFrame(list(enumerate(texts)), "line_no long, note string")
    got = [tuple(r) for r in c.lookalike_pairs(df, "line_no", "note").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(list(enumerate(texts)))


def brute(rows):
    out = set()
    for (a, s), (b, t) in itertools.combinations(sorted((k, t) for k, t in rows if t is not None), 2):
        if s != t and c.canonical(s) == c.canonical(t):
            out.add((a, b))
    return out


def test_pairs_equal_brute_force(spark):
    texts = ["fever", "fеver", "fever​", None, "", "​", "cough", "Cough", "naïve", "naïve"] + ["hot text"] * 40 + ["hot text"] * 3
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "line_no long, note string, canon string")
    got = [tuple(r) for r in c.lookalike_pairs(df, "line_no", "note").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty_table_and_columns(spark):
    df = spark.createDataFrame([], "line_no long, note string")
    assert c.lookalike_pairs(df, "line_no", "note").count() == 0
    long = "ä" * 50_000 + "​"
    df = spark.createDataFrame([(1, long), (2, None)], "k long, t string")
    got = {r["k"]: r["t"] for r in df.select("k", c.canonical_text("t").alias("t")).collect()}
    assert got == {1: "ä" * 50_000, 2: None}
