import random

import numpy as np
from hypothesis import given, settings, strategies as st

from caselode.llm import splitting as s

TEXT = st.lists(st.sampled_from(["word", "a", ". ", ", ", "\n", "\n\n", " ", "é", "- item\n", "## Head\n", "\r\n", "é", "日本"]), max_size=120).map("".join)


def units(text, unit):
    return len(text) if unit == "chars" else len(text.encode()) if unit == "bytes" else len(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")) - sum(w == "" for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))


@settings(max_examples=600, deadline=None)
@given(TEXT, st.sampled_from(["chars", "words", "bytes"]), st.integers(8, 40), st.integers(0, 4))
def test_pieces_are_whole_small_and_overlap(text, unit, most, overlap):
    got = s.pieces(text, unit, most, overlap)
    assert bool(got) == (units(text, unit) > most)
    if not got:
        return
    assert all(size <= most for _, _, size, _ in got)
    assert all(units(text[a:b], unit) == size for a, b, size, _ in got)
    assert got[0][0] == (0 if unit != "words" else len(text) - len(text.lstrip(" \t\r\n"))) and text[got[-1][1] :].strip(" \t\r\n") == ""
    for (a, b, _, _), (c, d, _, _) in zip(got, got[1:]):
        assert a < c <= b + (unit == "words") * 10**6 and d > b
        if unit == "chars":
            assert b - c >= overlap or c == b


def test_cut_is_the_rightmost_strongest():
    random.seed(1)
    for _ in range(200):
        n, length = random.randint(5, 60), random.randint(1, 5)
        strength = np.array([random.choice([-1, 0, 0, 1, 2, 3]) for _ in range(n)], dtype=np.int8)
        row = s.rightmost_maxima(strength, length)
        for i in range(n - length + 1):
            part = strength[i : i + length]
            best = max(j for j in range(length) if part[j] == part.max()) + i
            assert int(row[i]) & ((1 << 40) - 1) == best


def test_natural_boundaries_win():
    text = "One two three. Four five six seven eight.\n\nNine ten eleven twelve thirteen fourteen."
    (a, b, _, level), *_ = s.pieces(text, "chars", 50, 0)
    assert text[a:b].endswith("\n\n") and level == s.PARAGRAPH


def test_wrapped_lines_are_no_pause():
    strength, _ = s.strengths("He was seen by\nthe doctor. She left\n- one item\n- two items, and\nmore of it")
    text = "He was seen by\nthe doctor. She left\n- one item\n- two items, and\nmore of it"
    assert strength[text.index("the")] == s.WORD and strength[text.index("She")] == s.SENTENCE
    assert strength[text.index("- one")] == strength[text.index("- two")] == s.LINE and strength[text.index("more")] == s.WORD


def test_table(spark):
    docs = spark.createDataFrame([(1, "a b c " * 20, 7), (2, None, 7), (3, "", 7), (4, "a b", 7), (4, "a b", 7), (5, "x" * 300_000, 7)], "row_no long, document string, size int")
    limits = spark.createDataFrame([("w", "words", 10, 2), ("c", "chars", 100, 10), ("b", "bytes", 64, 0)], "limit_id string, unit string, max_size int, overlap int")
    found = {(r["limit_id"], r["row_no"]) for r in s.split_texts(docs, "row_no", "document", limits).where("piece_no = 1").collect()}
    assert found == {("w", 1), ("c", 1), ("b", 1), ("c", 5), ("b", 5)}
    assert s.split_texts(docs.limit(0), "row_no", "document", limits).count() == 0
    assert s.split_texts(docs, "row_no", "document", limits.limit(0)).count() == 0
    texts = {(r["limit_id"], r["row_no"], r["piece_no"]): r["piece"] for r in s.split_texts(docs, "row_no", "document", limits, True).collect()}
    assert texts["c", 1, 0] + texts["c", 1, 1][10:] == "a b c " * 20
