import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from caselode.functions import positions
from caselode.operators import corpus, evaluate, explain, fusion, negation, retrieve, sampling, skew, usage
from caselode.operators.filters import SearchFilters, SearchRequest, check_explain_ids


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_keep_first_and_latest(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (5, None), (4, "b")], "line_no long, note string")
    assert rows(corpus.keep_first(df, F.coalesce("note", F.lit("")), "line_no"), "line_no") == [(1,), (2,), (4,)]
    df = spark.createDataFrame([("k", 1, "x"), ("k", 2, None), ("l", 1, "z"), (None, 1, "n")], "k string, v long, t string")
    assert set(rows(corpus.latest_wins(df, ["k"], ["v"]), F.coalesce("k", F.lit("-")), F.coalesce("t", F.lit("-")))) == {("k", "-"), ("l", "z"), ("-", "n")}


@pytest.mark.parametrize("values", [[1, 2, 3, 4], [5], [3, 3, 3], list(range(100)), [7, 1, 9, 2, 2, 8, 4]])
def test_index_quantiles(spark, values):
    r = corpus.index_quantiles(spark.createDataFrame([(v,) for v in values], "v long"), F.col("v")).first()
    v, n = sorted(values), len(values)
    assert (r["min"], r["p25"], r["p75"], r["p95"], r["max"]) == (v[0], v[n // 4], v[3 * n // 4], v[int(0.95 * n)], v[-1])
    assert r["median"] == int((v[(n - 1) // 2] + v[n // 2]) / 2)


def test_stratified_sample_size_and_strata(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else "b" if i < 99 else None) for i in range(100)], "id long, s string")
    got = corpus.stratified_sample(df, ["s"], "id", 20).collect()
    assert len(got) == 20 and sum(r["s"] == "a" for r in got) in (18, 19)
    least = corpus.stratified_sample(df, ["s"], "id", 20, at_least_one=True).collect()
    assert len(least) == 20
    assert corpus.stratified_sample(df.limit(0), ["s"], "id", 5).count() == 0
    assert corpus.stratified_sample(df.limit(3), ["s"], "id", 5).count() == 3


def test_build_cases(spark):
    long = "word " * 70
    raw = spark.createDataFrame(
        [
            (1, "7", long + "died", "", '{"patient information": {"age": "18 months", "sex": "Boy"}}'),
            (2, "8", long + "died", long, None),
            (3, None, "short", long, "{bad"),
            (4, None, None, None, None),
        ],
        "line_no long, idx string, note string, full_note string, summary string",
    )
    got = {r["line_no"]: r for r in corpus.build_cases(raw).collect()}
    assert set(got) == {1, 3}
    assert (got[1]["case_id"], got[1]["sex"], got[1]["age"], got[1]["age_band"], got[1]["outcome_class"]) == ("acn-7", "male", 0, "0-9", "deceased")
    assert got[3]["case_id"] == "acn-3" and got[3]["quality_flags"] == ["no_structured_summary"] and got[1]["quality_flags"] == []


def lists(spark):
    d = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "b", 0.5, 2), ("r", "a", 0.7, 1)], "query_id string, case_id string, score double, rank int")
    s = spark.createDataFrame([("q", "c", 9.0, 1), ("q", "b", 5.0, 2), ("s", "z", 4.0, 1), ("s", "y", 4.0, 2)], "query_id string, case_id string, score double, rank int")
    return d, s


def test_fusion(spark):
    d, s = lists(spark)
    w = {(r["query_id"], r["case_id"]): (r["score"], r["rank"]) for r in fusion.weighted(d, s, "case_id").collect()}
    assert w["q", "c"] == (0.6, 1) and w["q", "a"] == (0.4, 2) and w["q", "b"] == (0.0, 3)
    assert w["r", "a"] == (0.0, 1) and w["s", "z"] == (0.0, 1) and w["s", "y"] == (0.0, 2)
    r = {(x["query_id"], x["case_id"]): x["score"] for x in fusion.reciprocal_ranks(d, s, "case_id").collect()}
    assert r["q", "b"] == round(2 / 62, 6) and r["q", "a"] == round(1 / 61, 6)
    only = fusion.weighted(d, s, "case_id", 1.0)
    assert all(0 <= x["score"] <= 1 for x in only.collect())


def test_rerank(spark):
    pool = spark.createDataFrame([("q", c, 1.0 - i / 10, i + 1) for i, c in enumerate("abcd")] + [("t", "a", 0.9, 1), ("t", "b", 0.8, 2)], "query_id string, case_id string, score double, rank int")
    logits = spark.createDataFrame([("q", "c", 5.0), ("q", "a", -1.0)], "query_id string, case_id string, logit double")
    out = {(r["query_id"], r["case_id"]): r for r in fusion.rerank_blend(pool, logits, "case_id", beta=0.9, depth=3).collect()}
    assert [out["q", c]["new_rank"] for c in "cbad"] == [1, 2, 3, 4]
    assert out["q", "d"]["blend"] == 0.7 and out["q", "c"]["blend"] == 0.9
    assert [out["t", c]["new_rank"] for c in "ab"] == [1, 2] and out["t", "a"]["reranked"] is False and out["q", "a"]["reranked"] is True


def test_metrics_by_hand(spark):
    gold = spark.createDataFrame([("1", ["a"]), ("2", ["b"]), ("3", ["c"]), ("4", ["d"])], "query_id string, relevant array<string>")
    ranked = spark.createDataFrame([("1", "a", 1), ("2", "b", 3), ("3", "c", 11), ("4", "x", 1)], "query_id string, case_id string, rank int")
    m = evaluate.metrics(evaluate.hit_ranks(gold, ranked, "case_id")).first()
    assert (m["queries"], m["recall_1"], m["recall_5"], m["recall_10"]) == (4, 0.25, 0.5, 0.5)
    assert m["mrr_10"] == round((1 + 1 / 3) / 4, 4) and m["ndcg_10"] == round((1 + 0.5) / 4, 4)


def test_dense_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)).round(3)
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 8), (102, [1.0])], "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in retrieve.dense_topn(df, df.where("vec_id < 60 and vec_id % 5 = 0"), 4, skip_self=True).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    for q, found in got.items():
        s = np.round(u @ u[q], 6)
        want = [j for j in sorted(range(60), key=lambda j: (-s[j], j)) if j != q][:4]
        assert [j for _, j in sorted(found)] == want
    assert len(got) == 12


def test_sparse(spark):
    docs = spark.createDataFrame([(1, "fever cough fever"), (2, "Cough"), (3, None), (4, ""), (5, "x y")], "id long, t string")
    q = spark.createDataFrame([("q", "Fever, fever and COUGH")], "query_id string, query string")
    got = rows(retrieve.sparse_topn(docs, "id", "t", q, "query_id", "query", 5), "rank", "id", "score")
    assert got == [(1, 1, round(5 / 3**0.5, 6)), (2, 2, 1.0)]


def test_postings_equal_the_plain_scores_with_and_without_pruning(spark):
    r = random.Random(8)
    common, rare = ["the", "of", "and", "was"], [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)]
    docs = [(i, " ".join(r.choices(common, k=r.randint(0, 12)) + r.choices(rare, k=r.randint(0, 9)))) for i in range(400)] + [(900, None), (901, "")]
    queries = [(f"q{i}", " ".join(r.choices(common, k=4) + r.choices(rare, k=i % 6))) for i in range(14)] + [("none", "zzz"), ("null", None)]
    df, q = spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(queries, "query_id string, query string")
    index = retrieve.postings(df, "id", "t")
    terms = retrieve.query_terms(q, "query_id", "query")
    want = rows(retrieve.sparse_topn(df, "id", "t", q, "query_id", "query", 7), "query_id", "rank", "id", "score")
    for limit in (10**9, 0):
        got = retrieve.postings_topn(index, retrieve.term_stats(index), "id", terms, 7, prune_hits=limit)
        assert rows(got, "query_id", "rank", "id", "score") == want
    few = df.where("id % 3 = 0")
    want = rows(retrieve.sparse_topn(few, "id", "t", q, "query_id", "query", 7), "query_id", "rank", "id", "score")
    got = retrieve.postings_topn(index, retrieve.term_stats(index), "id", terms, 7, few.select("id"), prune_hits=0)
    assert rows(got, "query_id", "rank", "id", "score") == want


def test_odd_vectors_have_no_say(spark):
    vectors = [(i, [float(i % 5 + 1), float(i % 3), 1.0]) for i in range(60)] + [(100, [1.0] * 9), (101, None), (102, [0.0] * 3), (103, [])]
    e = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {r["query_id"] for r in retrieve.dense_topn(e, e.where("vec_id % 10 = 0 or vec_id > 99"), 3).collect()}
    assert got == {0, 10, 20, 30, 40, 50}
    assert retrieve.dense_topn(e.where("vec_id = 101"), e, 3).count() == 0


def char_by_char(text):
    """For each character: does it lie in a scope? Read off the rule, character by character."""
    low, inside = text.lower(), [False] * len(text)
    at = 0
    whole = lambda i, w: low.startswith(w, i) and not re.match(r"\w", low[i - 1 : i]) and not re.match(r"\w", low[i + len(w) : i + len(w) + 1])
    while at < len(low):
        trigger = next((t for t in negation.TRIGGERS if whole(at, t)), None)
        if trigger is None:
            at += 1
            continue
        at += len(trigger)
        for i in range(at, min(at + negation.SCOPE_CHARS, len(low))):
            if low[i] in ".;:,()\n" or any(whole(i, w) for w in negation.ENDINGS):
                break
            inside[i] = True
    return inside


TEXTS = [
    "Denies fever, chills. No history of rash but cough; without pain", "no trash", "rash. no rash", "", "abdominal pain and vomiting, no fever, no diarrhea",
    "no fever, no cough. denied any pain however rash", "NOT seen;", "without " + "x" * 200, "nothing", "free of rash\nfever no", "no no fever", "not no fever and no evidence of disease except rash",
    "é no über fever. 𝒳 denies 𝒳 pain", None,
]


def test_spans_equal_the_rule_read_character_by_character(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", negation.negated_spans(F.col("t")).alias("s"), negation.native_scopes(F.col("t")).alias("n")).collect():
        if r["t"] is None:
            assert r["s"] is None
            continue
        got = [False] * len(r["t"])
        for a, b in r["s"]:
            got[a:b] = [True] * (b - a)
        assert got == char_by_char(r["t"]), r["t"]
        assert r["n"] == [r["t"][a:b] for a, b in r["s"]]


def test_status_and_polarity(spark):
    df = spark.createDataFrame([("no trash", "rash"), ("rash. no rash", "rash"), ("", "rash"), ("No RASH", "rash"), (None, "rash"), ("a rash", "")], "t string, w string")
    text = F.coalesce("t", F.lit(""))
    got = [r[0] for r in df.select(negation.term_status(text, negation.negated_spans(text), F.col("w"))).collect()]
    assert got == ["negated", "asserted", "absent", "negated", "absent", "absent"]
    p = spark.createDataFrame([("abdominal pain and vomiting, no fever, no diarrhea",), (None,), ("of the",)], "q string").select(negation.query_polarity(F.col("q")).alias("p")).select("p.*").collect()
    assert p[0]["negative"] == ["diarrhea", "fever"] and p[0]["positive"] == ["abdominal pain", "vomiting"]
    assert p[1]["positive"] == p[1]["negative"] == p[2]["positive"] == []


def test_positions_of_long_texts(spark):
    text = "no fever. " * 3000
    df = spark.createDataFrame([(text,)], "t string")
    s = df.select(negation.negated_spans(F.col("t")).alias("s"), positions.occurrences(F.col("t"), F.lit("FEVER")).alias("o")).first()
    assert [tuple(x) for x in s["s"]] == [(10 * i + 2, 10 * i + 8) for i in range(3000)]
    assert s["o"] == [10 * i + 3 for i in range(3000)]


def test_adjust(spark):
    pool = spark.createDataFrame([("q", "a", 0.98, 1), ("q", "b", 0.8, 2), ("q", "c", 0.5, 3)], "query_id string, case_id string, score double, rank int")
    q = spark.createDataFrame([("q", "vomiting and headache, no fever")], "query_id string, query string")
    texts = spark.createDataFrame([("a", "vomiting, no fever", "", ["x"]), ("b", "high fever, no vomiting", "", ["x"]), ("c", None, None, None)], "case_id string, document string, snippet string, quality_flags array<string>")
    got = {r["case_id"]: r for r in negation.adjust(pool, q, texts, "case_id", 10).collect()}
    assert got["a"]["adjusted"] == 1.0 and got["b"]["adjusted"] == 0.45 and got["c"]["adjusted"] == 0.5
    assert got["b"]["flags"] == ["x", "negation_conflict"] and got["b"]["new_rank"] == 3 and got["a"]["flags"] == ["x"]


def test_filters_and_requests(spark):
    df = spark.createDataFrame([(1, "female", 70, "improved"), (2, "female", None, "improved"), (3, "male", 80, "improved"), (4, "female", 60, "improved")], "id long, sex string, age int, outcome_class string")
    assert rows(SearchFilters(sex="female", age_min=60, outcome_class="improved").apply(df), "id") == [(1,), (4,)]
    assert SearchFilters(age_min=80, age_max=10).apply(df).count() == 0 and SearchFilters().apply(df).count() == 4
    for bad in (lambda: SearchFilters(sex="x"), lambda: SearchFilters(age_min=130), lambda: SearchRequest("ab"), lambda: SearchRequest("abc", k=26), lambda: check_explain_ids([]), lambda: check_explain_ids(list("abcdef"))):
        with pytest.raises(ValueError):
            bad()


def test_explanations(spark):
    good = '```json\n{"explanations": [{"case_id": "a", "differences": [{"detail": "d", "citations": ["a"]}]}]}\n```'
    outs = [
        ("k", 1, "no json"), ("k", 2, '{"explanations": []}'), ("k", 3, good), ("k", 4, good.replace('"a"]', '"z"]')), ("k", 5, good.replace('["a"]', "[]")),
        ("k", 6, good.replace("detail\": \"d", "detail\": \"We diagnose flu")), ("k", 7, good.replace('case_id": "a', 'case_id": "q')), ("m", 1, None),
    ]
    o = spark.createDataFrame(outs, "key string, attempt int, raw string")
    valid = spark.createDataFrame([("k", "a"), ("k", "b")], "key string, case_id string")
    v = explain.validate(o, valid)
    got = {(r["key"], r["attempt"]): r["problems"] for r in v.collect()}
    assert got == {
        ("k", 1): ["no_output"], ("k", 2): ["no_explanations"], ("k", 3): [], ("k", 4): ["bad_citation"], ("k", 5): ["uncited_claim"],
        ("k", 6): ["banned_phrase"], ("k", 7): ["unknown_case"], ("m", 1): ["no_output"],
    }
    first = {r["key"]: r for r in explain.first_valid(v, o.select("key")).collect()}
    assert first["k"]["attempt"] == 3 and first["m"]["degraded"] is True and first["m"]["confidence"] == "weak"


def test_cache(spark):
    now = F.lit(dt.datetime(2024, 1, 1, 12))
    empty = spark.createDataFrame([], "key string, value string, expires_at timestamp")
    new = spark.createDataFrame([("a", "1")], "key string, value string")
    cache = explain.cache_put(empty, new, now, 60)
    assert explain.cache_get(cache, new, now).count() == 1
    assert explain.cache_get(cache, new, F.lit(dt.datetime(2024, 1, 1, 13))).count() == 0
    k = spark.createDataFrame([(["b", "a"], ["a", "b"])], "x array<string>, y array<string>")
    r = k.select(explain.cache_key(F.lit("q"), F.col("x")).alias("x"), explain.cache_key(F.lit("q"), F.col("y")).alias("y")).first()
    assert r["x"] == r["y"]


def test_cache_hits_and_as_of(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    times = [0, 50, 111, 171, 172, 400]
    log = spark.createDataFrame([(i, "k", t(m)) for i, m in enumerate(times)] + [(9, None, t(5)), (10, None, t(6)), (11, "k", None)], "log_id long, q string, at timestamp")
    got = {r["log_id"]: r["hit"] for r in usage.cache_hits(log, ["q"], "at", "log_id", 3600).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: True, 5: False, 9: False, 10: True}
    versions = spark.createDataFrame([("k", t(40), 1), ("k", t(100), 2), (None, t(0), 3)], "q string, since timestamp, v int")
    got = {r["log_id"]: r["v"] for r in usage.as_of(log, versions, "q", "at", "since", "log_id", "v").collect()}
    assert (got[0], got[1], got[5], got[9], got[11]) == (None, 1, 2, None, None)


def test_salted_join_and_bounded_sample(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(300)] + [(999, None)], "id long, k string")
    small = spark.createDataFrame([("hot", 1), ("cold", 2), (None, 3)], "k string, v int")
    assert rows(skew.salted_join(big, small, ["k"], ["id"]), "id", "v") == rows(big.join(small, "k"), "id", "v")
    some = sampling.bounded_sample(big, "id", 100)
    assert 60 < some.count() <= 100 and rows(some, "id") == rows(sampling.bounded_sample(big, "id", 100), "id")
    assert sampling.bounded_sample(big, "id", 1000).count() == 301


def test_budget_and_lab_values(spark):
    df = spark.createDataFrame([("q", 1, 5), ("q", 2, 4), ("q", 3, 1)], "query_id string, rank int, words int")
    assert rows(usage.within_budget(df, F.col("words"), 9), "rank") == [(1,), (2,)]
    labs = spark.createDataFrame([(1, "x\nurea | 1,5 | mg/L\r\nD-dimer | 2 | g\nno | y"), (2, None)], "id long, t string")
    assert rows(usage.lab_values(labs, "id", "t"), "id", "value", "unit") == [(1, 1.5, "mg/L")] or rows(usage.lab_values(labs, "id", "t"), "id", "analyte", "value", "unit") == [(1, "D-dimer", 2.0, "g"), (1, "urea", 1.5, "mg/L")]


def test_approximate_search_recall(spark):
    import numpy as np

    from caselode.operators import ann

    rng = np.random.default_rng(5)
    centre = rng.normal(size=(20, 16))
    x = centre[rng.integers(0, 20, 3000)] + 0.6 * rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [1.0])], "vec_id long, embedding array<double>")
    queries = df.where("vec_id < 3000 and vec_id % 50 = 0")
    centres, nprobe = ann.fit_cells(df, "vec_id", "embedding", cells=32)
    assert nprobe < 32
    index = ann.index_rows(df, "vec_id", "embedding", centres)
    assert index.count() == 3000
    exact = {(r["query_id"], r["vec_id"]) for r in retrieve.dense_topn(df, queries, 10).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in ann.ann_topn(index, queries, centres, 10, "vec_id", "embedding", nprobe).collect()}
    assert len(found & exact) / len(exact) >= 0.9
    none = df.limit(0)
    assert ann.index_rows(none, "vec_id", "embedding", centres).count() == 0
