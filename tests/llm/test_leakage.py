import random

import numpy as np

from caselode.llm import leakage as k


def brute(docs, items):
    out = set()
    for i, text in items:
        w = k.words(text or "")
        grams = {tuple(w[j : j + 12]) for j in range(len(w) - 11)}
        for d, t in docs:
            v = k.words(t or "")
            if any(tuple(v[j : j + 12]) in grams for j in range(len(v) - 11)):
                out.add((d, i))
    return out


def test_found_equals_brute_force(spark):
    random.seed(5)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(random.choices(vocab, k=random.randint(8, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, "Ünï cödé, " * 8)]
    docs = []
    for d in range(120):
        words = random.choices(vocab, k=60)
        source = items[d % 25][1].split()
        at = random.randrange(0, max(1, len(source) - 10))
        part = source[at : at + random.choice([10, 11, 12, 13, 40])]
        docs.append((d, " ".join(words[:30] + [w.upper() for w in part] + words[30:])))
    docs += [(500, None), (501, ""), (502, "x Ünї cödé " + "Ünï cödé " * 8)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, seeds int")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = k.leak_alignments(df, it, "doc_id", "text", "item_id", "text").where("longest_run >= 12")
    rows = [(r["doc_id"], r["item_id"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, items)
    assert k.leak_alignments(df.limit(0), it, "doc_id", "text", "item_id", "text").count() == 0
    assert k.leak_alignments(df, it.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def slow_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = k.MATCH if a[i - 1] == b[j - 1] else k.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + same, h[i - 1][j] + k.GAP, h[i][j - 1] + k.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(1, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(1, 25))
        assert k.align(a, b)[0] == slow_alignment(list(a), list(b))


def test_edited_copy_scores_high():
    item = np.arange(1, 41)
    copy = np.delete(item, [7, 15, 30]).copy()
    copy[20] = 0
    score, _, run = k.align(item, np.concatenate([np.zeros(9, int), copy]))
    assert score / (k.MATCH * len(item)) > 0.7 and run < 20


def test_every_window_has_a_seed():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 10**9, 50)
    chosen = k.choose_seeds(keys, {int(x): int(rng.integers(0, 9)) for x in keys})
    span = k.WINDOW - k.GRAM + 1
    assert all(any(s <= p < s + span for p in chosen) for s in range(len(keys) - span + 1))


def edited(words, rng, way):
    out = []
    for i, w in enumerate(words):
        if way == "replace5" and i % 5 == 4 or way == "replace3" and i % 3 == 2:
            out.append(f"new{rng.randrange(999)}")
            continue
        if way == "drop4" and i % 4 == 3:
            continue
        out.append(w)
        if way == "insert2" and i % 2 or way == "insert1":
            out.append(f"new{rng.randrange(999)}")
        if way == "mixed" and rng.random() < 0.3:
            out[-1:] = rng.choice([[], ["other"], [w, "more"], [w, w]])
    return out


def test_edited_copies_are_all_found(spark):
    """Every document that full alignment gives at least half of an item's score is found; recall over all edits is 1."""
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(400)] + ["of", "the", "and", "no"] * 30
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 45)))) for i in range(30)]
    docs = []
    for d in range(240):
        noise = rng.choices(vocab, k=rng.choice([20, 60]))
        way = ["replace5", "replace3", "drop4", "insert2", "insert1", "mixed", "none", "mixed"][d % 8]
        part = edited(items[d % 30][1].split(), rng, way) if way != "none" else []
        docs.append((d, " ".join(noise[:10] + part + noise[10:])))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in k.leak_alignments(df, it, "doc_id", "text", "item_id", "text", edited=True).collect()}
    number = {w: i + 1 for i, w in enumerate(sorted({w for _, t in [*docs, *items] for w in t.split()}))}
    ids = lambda t: np.array([number[w] for w in t.split()])
    truth = {}
    for i, item in items:
        for d, text in docs:
            score = k.align(ids(item), ids(text))[0]
            if score >= k.MATCH * len(item.split()) / 2:
                truth[d, i] = score
    assert len(truth) > 150 and set(truth) <= set(got)
    assert all(got[pair]["score"] == score for pair, score in truth.items())
    five = {(r["doc_id"], r["item_id"]) for r in k.leak_alignments(df, it, "doc_id", "text", "item_id", "text").collect()}
    assert len(set(truth) - five) > 30  # what five-word seeds alone would lose


def test_repeated_documents_are_each_reported(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (1, "w1 w2 " + text)], "doc_id long, text string")
    it = spark.createDataFrame([(7, text)], "item_id long, text string")
    assert k.leak_alignments(df, it, "doc_id", "text", "item_id", "text").count() == 3
