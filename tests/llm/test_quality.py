import random

import numpy as np

from caselode.llm import quality as q

COMMON = [("en", w) for w in "the of and to in a was with for on at".split()] + [("fr", w) for w in "le la les de des et un une".split()]
PROSE = "the patient was seen at the clinic on monday and a letter to the doctor was sent with the results of the test in time for the visit"


def corpus(n=400):
    random.seed(4)
    rows, labels = [], []
    for i in range(n):
        if i % 6 == 0:
            text = "\n".join(f"- drug{random.randint(1, 50)} {random.randint(1, 90)} mg" for _ in range(random.randint(8, 20)))
            form = "list"
        elif i % 6 == 1:
            text = "\n".join(f"| urea | {random.random():.2f} | mg |" for _ in range(random.randint(8, 20)))
            form = "table"
        else:
            words = PROSE.split()
            text = " ".join(" ".join(random.sample(words, len(words))).capitalize() + "." for _ in range(random.randint(3, 9)))
            form = "prose"
        rows.append((i, text, "x"))
        if i % 2 == 0 or i < 40:
            labels.append((i, form))
    return rows, labels


def test_held_out_texts_are_told_apart(spark):
    rows, labels = corpus()
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "   \n", "x"), (1003, "word " * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats string")
    words = spark.createDataFrame(COMMON, "lang string, word string")
    told = spark.createDataFrame(labels, "doc_id long, form string")
    got = {r["doc_id"]: r for r in q.prose_report(docs, "doc_id", "text", words, told).collect()}
    assert len(got) == len(rows)
    for i in range(400):
        assert got[i]["is_prose"] == (i % 6 > 1), i
        assert abs(sum(got[i][f"c_{s}"] for s in q.STATS) - got[i]["distance"]) < 1e-6
    for i in (1000, 1001, 1002):
        assert got[i]["is_prose"] is None and got[i]["word_count"] == 0 and got[i]["distance"] is None
    assert got[1003]["is_prose"] is False


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    words = spark.createDataFrame([], "lang string, word string")
    told = spark.createDataFrame([], "doc_id long, form string")
    assert q.prose_report(docs, "doc_id", "text", words, told).count() == 0
    some = spark.createDataFrame([(1, "only one text here.")], "doc_id long, text string")
    assert q.prose_report(some, "doc_id", "text", words, told).count() == 1


def test_cut():
    d, odd = np.array([1.0, 2, 3, 50, 60]), np.array([False, False, False, True, True])
    assert 3 < q.best_cut(d, odd) < 50
    assert q.best_cut(d, np.zeros(5, bool)) == q.DEFAULT_CUT


def test_statistics():
    common = {"en": frozenset(w for lang, w in COMMON if lang == "en")}
    lang, n, stats = q.text_stats("The end of the day.\n- a, b", common)
    by = dict(zip(q.STATS, stats))
    assert (lang, n) == ("en", 8) and by["punct_line_share"] == 0.5 and by["digit_share"] == 0
    assert q.text_stats(" \n", common) is None
