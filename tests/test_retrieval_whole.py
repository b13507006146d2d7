import math
import os
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from caselode.operators import retrieve

SF = "/root/testdata/sf0.001"
WIDER = "/root/testdata/sf0.01"  # the smallest size with documents without a vector
NEEDS_DATA = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def brute_sparse(docs, queries, n):
    words = {k: re.findall(r"[^\W\d_]{2,}", t.lower()) for k, t in docs if t}
    out = set()
    for q, text in queries:
        want = Counter(re.findall(r"[^\W\d_]{2,}", (text or "").lower()))
        scores = [(-math.floor(sum(want[w] for w in ws) / math.sqrt(len(ws)) * 1e6 + 0.5), k) for k, ws in words.items() if any(w in want for w in ws)]
        out |= {(q, k, i + 1) for i, (_, k) in enumerate(sorted(scores)[:n])}
    return out


def test_sparse_blocks_equal_brute_force(spark, monkeypatch):
    docs = [(i, " ".join(f"w{'abcdefgh'[i * j % 7]}" for j in range(1 + i % 9))) for i in range(90)] + [(200, None), (201, ""), (202, "zz"), (203, "1 2 3")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    queries = df.where("doc_id % 10 = 0")
    monkeypatch.setattr(retrieve, "SPARSE_ROWS", 7)
    for block in (2000, 4):
        monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
        got = retrieve.sparse_topn_blocks(df, "doc_id", "text", queries, "doc_id", "text", 5)
        want = brute_sparse(docs, [d for d in docs if d[0] % 10 == 0], 5)
        assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got.collect()} == want
        plain = retrieve.sparse_topn(df, "doc_id", "text", queries, "doc_id", "text", 5)
        cols = ["query_id", "doc_id", "score", "rank"]
        assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, plain.select(cols).collect()))


@NEEDS_DATA
def test_hybrid_over_all_documents(spark):
    got = entry.queries()["hybrid_search_full"](spark, WIDER).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{WIDER}/documents.parquet").collect()}
    vectors = {r["vec_id"] for r in spark.read.parquet(f"{WIDER}/embeddings.parquet").select("vec_id").collect()}
    answerable = {k for k, t in docs.items() if k % 50 == 0 and (k in vectors or re.search(r"[^\W\d_]{2,}", t or ""))}
    assert {r["query_id"] for r in got} == answerable
    assert {r["doc_id"] for r in got} - vectors
    assert all(r["snippet"] == (docs.get(r["doc_id"]) or "")[:300] for r in got)


@NEEDS_DATA
def test_whole_grid_and_all_modes(spark):
    queries = entry.queries()
    part, whole = ({(r["depth"], r["beta"]): r.asDict() for r in queries[n](spark, SF).collect()} for n in ("depth_beta_sweep", "depth_beta_sweep_full"))
    assert set(whole) - set(part) == {(100, b) for b in (0.6, 0.7, 0.8, 0.9, 1.0)}
    assert all({**whole[c], "best": 0} == {**row, "best": 0} for c, row in part.items())
    best = min(whole, key=lambda c: (-whole[c]["ndcg_10"], c))
    assert [c for c, row in whole.items() if row["best"]] == [best]
    part, whole = ({r["mode"]: r for r in queries[n](spark, SF).collect()} for n in ("metrics_by_mode", "metrics_by_mode_full"))
    assert set(whole) == set(part) | {"rrf_50"} and all(whole[m] == part[m] for m in part)
