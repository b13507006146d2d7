"""Retrieval, fusion, reranking and evaluation queries with their DuckDB equivalents.

Gold queries run against the latest version of every case on two sparse branches (document, reference note);
documents with a vector of the same id make the hybrid corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from caselode.operators import ann, corpus, evaluate, fusion, retrieve
from caselode.operators.filters import SearchFilters
from caselode.operators.skew import spread
from caselode.session import cut_lineage
from caselode.sources import files
from caselode.sources.tables import table

EVERY = 50  # ids divisible by this are the stated query set


def latest_cases(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "cases_clean").select("case_id", "row_no", "built_at", "document", "reference_note", "sex", "age", "outcome_class")
    return corpus.latest_rows(cases, "case_id", "built_at", "row_no")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_queries").select("query_id", "query", F.col("relevant_case_ids").alias("relevant"))


def _postings(spark: SparkSession, d: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Postings of the latest version of every case, and their term statistics; written once for the given tables."""
    source = f"{d}/cases_clean.parquet"

    def build() -> DataFrame:
        cases = spread(table(spark, d, "cases_clean").select("case_id", "row_no", "built_at", text))
        return retrieve.laid_out(retrieve.postings(corpus.latest_rows(cases, "case_id", "built_at", "row_no"), "case_id", text), "case_id")

    index = files.stored_table(spark, f"postings-{text}", [source], build)
    return index, files.stored_table(spark, f"terms-{text}", [source], lambda: retrieve.term_stats(index))


def retrieval_index(spark: SparkSession, d: str) -> DataFrame:
    """Builds the postings of both texts, where they aren't there yet; how many terms and postings they have."""
    parts = None
    for text in ("document", "reference_note"):
        part = _postings(spark, d, text)[1].agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.max("df").alias("most")).withColumn("field", F.lit(text))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _branch(spark: SparkSession, d: str, text: str, n: int = 100, filters: SearchFilters | None = None) -> DataFrame:
    index, stats = _postings(spark, d, text)
    within = filters.apply(latest_cases(spark, d).where("case_id is not null")).select("case_id") if filters else None
    return retrieve.postings_topn(index, stats, "case_id", retrieve.query_terms(_gold(spark, d), "query_id", "query"), n, within)


_CASES_SQL = """
cases AS (SELECT * FROM cases_clean QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY built_at DESC, row_no DESC) = 1),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (
         SELECT query_id, unnest(regexp_extract_all(lower(query), '\\p{L}{2,}')) AS term FROM gold_queries) GROUP BY ALL)"""


def _branch_sql(name: str, text: str, n: int = 100, where: str = "true") -> str:
    return f"""
{name}_w AS (SELECT case_id, regexp_extract_all(lower({text}), '\\p{{L}}{{2,}}') AS w FROM cases WHERE {where}),
{name}_e AS (SELECT case_id, len(w) AS len, unnest(w) AS term FROM {name}_w WHERE len(w) > 0),
{name}_tf AS (SELECT case_id, len, term, count(*) AS tf FROM {name}_e WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
{name}_s AS (SELECT query_id, case_id, round(sum(tf * qtf) / sqrt(len), 6) AS score FROM {name}_tf JOIN qt USING (term) GROUP BY query_id, case_id, len),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank FROM {name}_s QUALIFY rank <= {n})"""


_TWO_SQL = f"WITH {_CASES_SQL}, {_branch_sql('doc', 'document')}, {_branch_sql('note', 'reference_note')}"
_NORM = "(score - min(score) OVER w) / coalesce(nullif(max(score) OVER w - min(score) OVER w, 0.0), 1.0)"
_NORMED_SQL = f"""{_TWO_SQL},
dn AS (SELECT query_id, case_id, rank, {_NORM} AS score FROM doc WINDOW w AS (PARTITION BY query_id)),
sn AS (SELECT query_id, case_id, rank, {_NORM} AS score FROM note WINDOW w AS (PARTITION BY query_id)),
both_n AS (SELECT coalesce(dn.query_id, sn.query_id) AS query_id, coalesce(dn.case_id, sn.case_id) AS case_id,
                dn.score AS d, sn.score AS s, dn.rank AS d_rank, sn.rank AS s_rank
         FROM dn FULL JOIN sn ON dn.query_id = sn.query_id AND dn.case_id = sn.case_id)"""
_FUSED_SQL = f"""{_NORMED_SQL},
fused0 AS (SELECT query_id, case_id, d_rank, s_rank, round(0.4::DOUBLE * coalesce(d, 0.0) + (1 - 0.4::DOUBLE) * coalesce(s, 0.0), 4) AS score FROM both_n),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d_rank ASC NULLS LAST, s_rank ASC NULLS LAST, case_id) AS rank FROM fused0)"""


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieve.dense_topn(e, e.where(F.col("vec_id") % EVERY == 0), 10)


def dense_knn_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieve.dense_topn(e, e.where(F.col("vec_id") % EVERY == 0), 5, skip_self=True)


def _dense_sql(n: int, extra: str = "") -> str:
    return f"""
WITH s AS (
  SELECT q.vec_id AS query_id, e.vec_id,
         round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) /
               sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) /
               sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % {EVERY} = 0 {extra})
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {n}
"""


def dense_ann(spark: SparkSession, d: str) -> DataFrame:
    """The inverted-file index over all vectors, written once by cell, asked for the stated query set."""
    e, source = table(spark, d, "embeddings"), [f"{d}/embeddings.parquet"]

    def fitted() -> DataFrame:
        centres, nprobe = ann.fit_cells(e, "vec_id", "embedding")
        return spark.createDataFrame([(i, nprobe, c.tolist()) for i, c in enumerate(centres)], "cell int, nprobe int, centre array<double>")

    cells = sorted(files.stored_table(spark, "ann-cells", source, fitted).collect())
    centres = np.array([r["centre"] for r in cells])
    index = files.stored_table(spark, "ann-index", source, lambda: ann.laid_out(ann.index_rows(e, "vec_id", "embedding", centres)))
    return ann.ann_topn(index, e.where(F.col("vec_id") % EVERY == 0), centres, 10, "vec_id", "embedding", cells[0]["nprobe"])


def facet_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of each hit by facet: the two branches side by side."""
    parts = None
    for facet, text in (("document", "document"), ("note", "reference_note")):
        part = _branch(spark, d, text).select("query_id", "case_id", F.lit(facet).alias("facet"), "score")
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("query_id", "case_id").pivot("facet", ["document", "note"]).agg(F.max("score"))


def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return _branch(spark, d, "document", 10)


def filter_conjunctive(spark: SparkSession, d: str) -> DataFrame:
    return _branch(spark, d, "document", 10, SearchFilters(sex="female", age_min=60, outcome_class="improved"))


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _branch(spark, d, "document"), _branch(spark, d, "reference_note")


def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    return _branch(spark, d, "document").select("query_id", "case_id", F.round(fusion.minmax(F.col("score"), "query_id"), 6).alias("norm"))


def fusion_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.weighted(*_lists(spark, d), "case_id").select("query_id", "case_id", "score", "rank")


def fusion_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_ranks(*_lists(spark, d), "case_id").select("query_id", "case_id", "score", "rank")


def fusion_overlap(spark: SparkSession, d: str) -> DataFrame:
    one, two = (x.select("query_id", "case_id") for x in _lists(spark, d))
    sets = one.select("query_id", "case_id", F.lit(1).alias("one"), F.lit(0).alias("two")).unionByName(
        two.select("query_id", "case_id", F.lit(0).alias("one"), F.lit(1).alias("two"))
    )
    pairs = sets.groupBy("query_id", "case_id").agg(F.max("one").alias("one"), F.max("two").alias("two"))
    return pairs.groupBy("query_id").agg(
        F.count("*").alias("united"), F.sum(F.col("one") * F.col("two")).alias("common"), F.sum(F.col("one") * (1 - F.col("two"))).alias("only_first")
    )


def saved_search_changes(spark: SparkSession, d: str) -> DataFrame:
    """New hits of the document branch against the note branch's saved ten."""
    new, old = (x.where("rank <= 10").select("query_id", "case_id") for x in _lists(spark, d))
    return new.join(old, ["query_id", "case_id"], "left_anti")


def _hybrid_corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label"), "doc_id")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Dense and sparse top 100 of each query document, fused; the ten best with snippet."""
    both = _hybrid_corpus(spark, d)
    queries = both.where(F.col("doc_id") % EVERY == 0)
    dense = retrieve.dense_topn(both, queries, 100, "doc_id")
    sparse = retrieve.sparse_topn(both, "doc_id", "text", queries, "doc_id", "text", 100)
    top = fusion.weighted(dense, sparse, "doc_id").where("rank <= 10").select("query_id", "doc_id", "score", "rank")
    return top.join(both.select("doc_id", F.substring("text", 1, 300).alias("snippet")), "doc_id", "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))


def hybrid_search_full(spark: SparkSession, d: str) -> DataFrame:
    """As hybrid_search, over every document and every vector: a text found by one branch alone counts 0 in the other."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = docs.where(F.col("doc_id") % EVERY == 0)
    dense = retrieve.dense_topn(vectors, vectors.join(queries.select("doc_id"), "doc_id", "left_semi"), 100, "doc_id")
    sparse = retrieve.sparse_topn_blocks(docs, "doc_id", "text", queries, "doc_id", "text", 100)
    top = fusion.weighted(dense, sparse, "doc_id").where("rank <= 10").select("query_id", "doc_id", "score", "rank")
    snippets = docs.select("doc_id", F.substring("text", 1, 300).alias("snippet"))
    return top.join(snippets, "doc_id", "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))


HYBRID = f"""
WITH c AS (SELECT doc_id, text, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
ds AS (SELECT q.doc_id AS query_id, e.doc_id,
         round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) /
               sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) /
               sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS score
       FROM c q, c e WHERE q.doc_id % {EVERY} = 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds QUALIFY rank <= 100),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}{{2,}}') AS w FROM c),
e AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w WHERE len(w) > 0),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM e GROUP BY ALL),
sp0 AS (SELECT q.doc_id AS query_id, t.doc_id, round(sum(t.tf * q.tf) / sqrt(t.len), 6) AS score
        FROM tf t JOIN tf q USING (term) WHERE q.doc_id % {EVERY} = 0 GROUP BY q.doc_id, t.doc_id, t.len),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sp0 QUALIFY rank <= 100),
dn AS (SELECT query_id, doc_id, rank, {_NORM} AS score FROM dense WINDOW w AS (PARTITION BY query_id)),
sn AS (SELECT query_id, doc_id, rank, {_NORM} AS score FROM sparse WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT coalesce(dn.query_id, sn.query_id) AS query_id, coalesce(dn.doc_id, sn.doc_id) AS doc_id, dn.rank AS d_rank, sn.rank AS s_rank,
             round(0.4::DOUBLE * coalesce(dn.score, 0.0) + (1 - 0.4::DOUBLE) * coalesce(sn.score, 0.0), 4) AS score
      FROM dn FULL JOIN sn ON dn.query_id = sn.query_id AND dn.doc_id = sn.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d_rank ASC NULLS LAST, s_rank ASC NULLS LAST, doc_id) AS rank FROM f)
SELECT query_id, doc_id, score, rank, coalesce(substring(text, 1, 300), '') AS snippet FROM r LEFT JOIN c USING (doc_id) WHERE rank <= 10
"""


HYBRID_FULL = (
    HYBRID.replace("WITH c AS (SELECT doc_id, text, embedding FROM documents JOIN embeddings ON vec_id = doc_id),", "WITH c AS (SELECT doc_id, text FROM documents), x AS (SELECT vec_id AS doc_id, embedding FROM embeddings),")
    .replace(f"FROM c q, c e WHERE q.doc_id % {EVERY} = 0)", f"FROM x q JOIN documents USING (doc_id), x e WHERE q.doc_id % {EVERY} = 0)")
    .replace("SELECT q.doc_id AS query_id, e.doc_id,", "SELECT q.doc_id AS query_id, e.doc_id AS doc_id,")
)


def _logits(spark: SparkSession, d: str) -> DataFrame:
    """Relevance logged for a query and case stands in for a reranker's logit."""
    return table(spark, d, "search_log").where("top_case_id is not null").groupBy("query_id", F.col("top_case_id").alias("case_id")).agg(F.max("top_score").alias("logit"))


def _pool(spark: SparkSession, d: str, n: int = 100) -> DataFrame:
    return fusion.weighted(*_lists(spark, d), "case_id").where(F.col("rank") <= n).select("query_id", "case_id", "score", "rank")


def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    out = fusion.rerank_blend(_pool(spark, d, 50), _logits(spark, d), "case_id", depth=50)
    return out.select("query_id", "case_id", "blend", "new_rank", "reranked")


def rerank_depth_blend(spark: SparkSession, d: str) -> DataFrame:
    out = fusion.rerank_blend(_pool(spark, d), _logits(spark, d), "case_id", depth=20, beta=0.6)
    return out.select("query_id", "case_id", "blend", "new_rank")


def rerank_failsoft(spark: SparkSession, d: str) -> DataFrame:
    """A reranker that answers just some queries: the others keep their retrieval order."""
    some = _logits(spark, d).where(F.col("query_id") < "gq-030")
    return fusion.rerank_blend(_pool(spark, d, 30), some, "case_id", depth=30).select("query_id", "case_id", "blend", "new_rank", "reranked")


def _rerank_ctes(pool: int, depth: int, beta: float, logits: str = "true") -> str:
    norm = lambda c: f"({c} - min({c}) OVER w) / coalesce(nullif(max({c}) OVER w - min({c}) OVER w, 0.0), 1.0)"
    return f"""
lg AS (SELECT query_id, top_case_id AS case_id, max(top_score) AS logit FROM search_log WHERE top_case_id IS NOT NULL AND {logits} GROUP BY ALL),
j AS (SELECT f.query_id, f.case_id, f.score, f.rank, count(logit) OVER (PARTITION BY f.query_id) > 0 AS reranked, coalesce(logit, 0.0) AS logit, f.rank > {depth} AS tail
      FROM fused f LEFT JOIN lg USING (query_id, case_id) WHERE f.rank <= {pool}),
b AS (SELECT *, CASE WHEN tail OR NOT reranked THEN score ELSE round({beta}::DOUBLE * {norm("logit")} + (1 - {beta}::DOUBLE) * {norm("score")}, 4) END AS blend
      FROM j WINDOW w AS (PARTITION BY query_id, tail)),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tail, CASE WHEN NOT tail THEN -blend END, rank, case_id) AS new_rank FROM b)"""


def _rerank_sql(pool: int, depth: int, beta: float, cols: str, logits: str = "true") -> str:
    return f"{_FUSED_SQL}, {_rerank_ctes(pool, depth, beta, logits)} SELECT {cols} FROM rr"


def confidence_labels(spark: SparkSession, d: str) -> DataFrame:
    return fusion.confidence(_pool(spark, d, 11)).where("rank <= 10").select("query_id", "case_id", "rank", "margin", "confidence")


def cohort_outcomes(spark: SparkSession, d: str) -> DataFrame:
    top = _branch(spark, d, "document", 25).join(latest_cases(spark, d).select("case_id", "outcome_class"), "case_id")
    counts = top.where("outcome_class is not null").groupBy("query_id", F.lower(F.trim("outcome_class")).alias("outcome")).agg(F.count("*").alias("cases"))
    total = counts.groupBy("query_id").agg(F.sum("cases").alias("total"))
    return counts.join(total, "query_id").select("query_id", "outcome", "cases", F.round(F.col("cases") / F.col("total"), 4).alias("share"))


def _modes(spark: SparkSession, d: str, full: bool = False) -> DataFrame:
    doc, note = (cut_lineage(x) for x in _lists(spark, d))
    lists = {
        "document": doc,
        "note": note,
        "rrf": fusion.reciprocal_ranks(doc, note, "case_id"),
        "weighted": fusion.weighted(doc, note, "case_id"),
        "rerank": fusion.rerank_blend(fusion.weighted(doc, note, "case_id").where("rank <= 100"), _logits(spark, d), "case_id").withColumn("rank", F.col("new_rank")),
    }
    if full:
        lists["rrf_50"] = fusion.reciprocal_ranks(doc.where("rank <= 50"), note.where("rank <= 50"), "case_id")
    out = None
    for mode, ranked in lists.items():
        part = ranked.select(F.lit(mode).alias("mode"), "query_id", "case_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def metrics_by_mode(spark: SparkSession, d: str) -> DataFrame:
    hits = evaluate.hit_ranks(_gold(spark, d), _modes(spark, d), "case_id", by=("mode",))
    return evaluate.metrics(hits, ("mode",))


def metrics_by_mode_full(spark: SparkSession, d: str) -> DataFrame:
    """All modes of the ablation: also reciprocal ranks of lists cut to 50."""
    return evaluate.metrics(evaluate.hit_ranks(_gold(spark, d), _modes(spark, d, full=True), "case_id", by=("mode",)), ("mode",))


def ablation_table(spark: SparkSession, d: str) -> DataFrame:
    """The ablation as a table: one row per metric, the modes as columns, and the best value."""
    modes = ["document", "note", "rrf", "rrf_50", "weighted", "rerank"]
    long = metrics_by_mode_full(spark, d).unpivot("mode", ["recall_1", "recall_5", "recall_10", "mrr_10", "ndcg_10"], "metric", "value")
    return long.groupBy("metric").pivot("mode", modes).agg(F.first("value")).withColumn("best", F.greatest(*modes))


def alpha_sweep(spark: SparkSession, d: str) -> DataFrame:
    doc, note = (cut_lineage(x) for x in _lists(spark, d))
    alphas = F.broadcast(spark.createDataFrame([(x,) for x in (0.3, 0.4, 0.5, 0.6, 0.7)], "alpha double"))  # five settings
    parts = fusion.weighted(doc.crossJoin(alphas), note.crossJoin(alphas), "case_id", "alpha", ("alpha", "query_id"))
    table_ = evaluate.metrics(evaluate.hit_ranks(_gold(spark, d), parts, "case_id", by=("alpha",)), ("alpha",))
    return evaluate.best_setting(table_, "ndcg_10", ["alpha"])


def _depth_beta(spark: SparkSession, d: str, depths: tuple[int, ...]) -> DataFrame:
    pool = cut_lineage(_pool(spark, d))
    grid = spark.createDataFrame([(depth, beta) for depth in depths for beta in (0.6, 0.7, 0.8, 0.9, 1.0)], "depth int, beta double")
    cells = pool.crossJoin(F.broadcast(grid))  # 25 or 30 cells
    by = ("depth", "beta", "query_id")
    ranked = fusion.rerank_blend(cells, _logits(spark, d), "case_id", "beta", "depth", by).withColumn("rank", F.col("new_rank"))
    hits = evaluate.hit_ranks(_gold(spark, d), ranked, "case_id", by=("depth", "beta"))
    return evaluate.best_setting(evaluate.metrics(hits, ("depth", "beta")), "ndcg_10", ["depth", "beta"])


def depth_beta_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _depth_beta(spark, d, (10, 15, 20, 30, 50))


def depth_beta_sweep_full(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid: also depth 100, all of the pool; at beta 1 that is the order of the reranker alone."""
    return _depth_beta(spark, d, (10, 15, 20, 30, 50, 100))


def pool_ceiling(spark: SparkSession, d: str) -> DataFrame:
    gold = _gold(spark, d).select("query_id", F.explode("relevant").alias("case_id"))
    hit = gold.join(_pool(spark, d), ["query_id", "case_id"], "left_semi").select("query_id").distinct()
    return gold.select("query_id").distinct().join(hit.withColumn("hit", F.lit(1)), "query_id", "left").agg(
        F.count("*").alias("queries"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall_100")
    )


_METRICS_SQL = """count(*) AS queries,
  round(avg(CASE WHEN hit <= 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_1, round(avg(CASE WHEN hit <= 5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_5,
  round(avg(CASE WHEN hit <= 10 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_10,
  round(avg(CASE WHEN hit <= 10 THEN 1.0::DOUBLE / hit ELSE 0 END), 4) AS mrr_10, round(avg(CASE WHEN hit <= 10 THEN 1.0::DOUBLE / log2(hit + 1) ELSE 0 END), 4) AS ndcg_10"""
_RRF_SQL = """
rrf0 AS (SELECT coalesce(dn.query_id, sn.query_id) AS query_id, coalesce(dn.case_id, sn.case_id) AS case_id, dn.rank AS d_rank, sn.rank AS s_rank,
                round(coalesce(1.0::DOUBLE / (60 + dn.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + sn.rank), 0.0), 6) AS score
         FROM doc dn FULL JOIN note sn ON dn.query_id = sn.query_id AND dn.case_id = sn.case_id),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d_rank ASC NULLS LAST, s_rank ASC NULLS LAST, case_id) AS rank FROM rrf0)"""
_LAST_SQL = """
rel AS (SELECT DISTINCT query_id, unnest(relevant_case_ids) AS case_id FROM gold_queries)"""
METRICS_BY_MODE = f"""{_FUSED_SQL}, {_RRF_SQL}, {_LAST_SQL},
{_rerank_ctes(100, 50, 0.9)},
ranked AS (SELECT 'document' AS mode, query_id, case_id, rank FROM doc UNION ALL SELECT 'note', query_id, case_id, rank FROM note
  UNION ALL SELECT 'rrf', query_id, case_id, rank FROM rrf UNION ALL SELECT 'weighted', query_id, case_id, rank FROM fused
  UNION ALL SELECT 'rerank', query_id, case_id, new_rank FROM rr),
hits AS (SELECT mode, query_id, min(rank) AS hit FROM ranked JOIN rel USING (query_id, case_id) GROUP BY ALL),
every AS (SELECT DISTINCT mode, g.query_id FROM ranked, gold_queries g)
SELECT mode, {_METRICS_SQL} FROM every LEFT JOIN hits USING (mode, query_id) GROUP BY mode
"""
_RRF50_SQL = _RRF_SQL.replace("rrf0", "rrf50_0").replace("rrf AS", "rrf50 AS").replace("FROM doc dn FULL JOIN note sn", "FROM (SELECT * FROM doc WHERE rank <= 50) dn FULL JOIN (SELECT * FROM note WHERE rank <= 50) sn")
METRICS_FULL = METRICS_BY_MODE.replace(f"{_RRF_SQL}, {_LAST_SQL}", f"{_RRF_SQL}, {_RRF50_SQL}, {_LAST_SQL}").replace("UNION ALL SELECT 'rerank'", "UNION ALL SELECT 'rrf_50', query_id, case_id, rank FROM rrf50 UNION ALL SELECT 'rerank'")
ALPHA_SWEEP = f"""{_NORMED_SQL}, {_LAST_SQL},
a AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS alpha),
f0 AS (SELECT alpha, query_id, case_id, d_rank, s_rank, round(alpha * coalesce(d, 0.0) + (1 - alpha) * coalesce(s, 0.0), 4) AS score FROM both_n, a),
f AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, d_rank ASC NULLS LAST, s_rank ASC NULLS LAST, case_id) AS rank FROM f0),
hits AS (SELECT alpha, query_id, min(rank) AS hit FROM f JOIN rel USING (query_id, case_id) GROUP BY ALL),
m AS (SELECT alpha, {_METRICS_SQL} FROM (SELECT alpha, query_id FROM a, gold_queries) LEFT JOIN hits USING (alpha, query_id) GROUP BY alpha)
SELECT *, row_number() OVER (ORDER BY ndcg_10 DESC, alpha) = 1 AS best FROM m
"""
_SQL_NORM = lambda c: f"({c} - min({c}) OVER w) / coalesce(nullif(max({c}) OVER w - min({c}) OVER w, 0.0), 1.0)"
DEPTH_BETA_SWEEP = f"""{_FUSED_SQL}, {_LAST_SQL},
grid AS (SELECT depth, beta::DOUBLE AS beta FROM (SELECT unnest([10, 15, 20, 30, 50]) AS depth), (SELECT unnest([0.6, 0.7, 0.8, 0.9, 1.0]) AS beta)),
lg AS (SELECT query_id, top_case_id AS case_id, max(top_score) AS logit FROM search_log WHERE top_case_id IS NOT NULL GROUP BY ALL),
j AS (SELECT depth, beta, f.query_id, f.case_id, f.score, f.rank, count(logit) OVER (PARTITION BY depth, beta, f.query_id) > 0 AS reranked,
             coalesce(logit, 0.0) AS logit, f.rank > depth AS tail FROM fused f LEFT JOIN lg USING (query_id, case_id), grid WHERE f.rank <= 100),
b AS (SELECT *, CASE WHEN tail OR NOT reranked THEN score ELSE round(beta * {_SQL_NORM("logit")} + (1 - beta) * {_SQL_NORM("score")}, 4) END AS blend
      FROM j WINDOW w AS (PARTITION BY depth, beta, query_id, tail)),
r AS (SELECT *, row_number() OVER (PARTITION BY depth, beta, query_id ORDER BY tail, CASE WHEN NOT tail THEN -blend END, rank, case_id) AS new_rank FROM b),
hits AS (SELECT depth, beta, query_id, min(new_rank) AS hit FROM r JOIN rel USING (query_id, case_id) GROUP BY ALL),
m AS (SELECT depth, beta, {_METRICS_SQL} FROM (SELECT depth, beta, query_id FROM grid, gold_queries) LEFT JOIN hits USING (depth, beta, query_id) GROUP BY depth, beta)
SELECT *, row_number() OVER (ORDER BY ndcg_10 DESC, depth, beta) = 1 AS best FROM m
"""

QUERIES = {
    f.__name__: f
    for f in (
        retrieval_index, dense_topk, dense_knn_batch, dense_ann, facet_scores, sparse_topk, filter_conjunctive, minmax_norm, fusion_weighted, fusion_rrf, fusion_overlap,
        saved_search_changes, hybrid_search, hybrid_search_full, rerank_blend, rerank_depth_blend, rerank_failsoft, confidence_labels, cohort_outcomes,
        metrics_by_mode, metrics_by_mode_full, ablation_table, alpha_sweep, depth_beta_sweep, depth_beta_sweep_full, pool_ceiling,
    )
}
ORACLE = {
    "retrieval_index": f"WITH {_CASES_SQL}, "
    + "e AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS field, case_id, unnest(regexp_extract_all(lower({c}), '\\p{{L}}{{2,}}')) AS term FROM cases" for c in ("document", "reference_note"))
    + "), s AS (SELECT field, term, count(*) AS df FROM e GROUP BY ALL) SELECT field, count(*) AS terms, CAST(sum(df) AS BIGINT) AS postings, max(df) AS most FROM s GROUP BY field",
    "dense_topk": _dense_sql(10),
    "dense_knn_batch": _dense_sql(5, "AND q.vec_id <> e.vec_id"),
    "sparse_topk": f"WITH {_CASES_SQL}, {_branch_sql('doc', 'document', 10)} SELECT * FROM doc",
    "filter_conjunctive": f"WITH {_CASES_SQL}, {_branch_sql('doc', 'document', 10, "sex = 'female' AND age >= 60 AND outcome_class = 'improved'")} SELECT * FROM doc",
    "facet_scores": f"""{_TWO_SQL} SELECT coalesce(doc.query_id, note.query_id) AS query_id, coalesce(doc.case_id, note.case_id) AS case_id,
        doc.score AS document, note.score AS note FROM doc FULL JOIN note ON doc.query_id = note.query_id AND doc.case_id = note.case_id""",
    "minmax_norm": f"{_NORMED_SQL} SELECT query_id, case_id, round(score, 6) AS norm FROM dn",
    "fusion_weighted": f"{_FUSED_SQL} SELECT query_id, case_id, score, rank FROM fused",
    "fusion_rrf": f"{_TWO_SQL}, {_RRF_SQL} SELECT query_id, case_id, score, rank FROM rrf",
    "fusion_overlap": f"""{_TWO_SQL} SELECT query_id, count(*) AS united, count(*) FILTER (one = 1 AND two = 1) AS common, count(*) FILTER (two = 0) AS only_first
        FROM (SELECT query_id, case_id, max(one) AS one, max(two) AS two FROM (SELECT query_id, case_id, 1 AS one, 0 AS two FROM doc
              UNION ALL SELECT query_id, case_id, 0, 1 FROM note) GROUP BY ALL) GROUP BY query_id""",
    "saved_search_changes": f"""{_TWO_SQL} SELECT query_id, case_id FROM doc WHERE rank <= 10
        AND (query_id, case_id) NOT IN (SELECT query_id, case_id FROM note WHERE rank <= 10)""",
    "hybrid_search": HYBRID,
    "hybrid_search_full": HYBRID_FULL,
    "rerank_blend": _rerank_sql(50, 50, 0.9, "query_id, case_id, blend, new_rank, reranked"),
    "rerank_depth_blend": _rerank_sql(100, 20, 0.6, "query_id, case_id, blend, new_rank"),
    "rerank_failsoft": _rerank_sql(30, 30, 0.9, "query_id, case_id, blend, new_rank, reranked", "query_id < 'gq-030'"),
    "confidence_labels": f"""{_FUSED_SQL}, m AS (SELECT query_id, case_id, rank, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS margin FROM fused WHERE rank <= 11)
        SELECT query_id, case_id, rank, round(margin, 6) AS margin, CASE WHEN margin >= 0.1::DOUBLE THEN 'high' WHEN margin >= 0.02::DOUBLE THEN 'moderate' ELSE 'weak' END AS confidence
        FROM m WHERE rank <= 10""",
    "cohort_outcomes": f"""WITH {_CASES_SQL}, {_branch_sql('doc', 'document', 25)},
        c AS (SELECT query_id, lower(trim(outcome_class)) AS outcome, count(*) AS cases FROM doc JOIN cases USING (case_id) WHERE outcome_class IS NOT NULL GROUP BY ALL)
        SELECT query_id, outcome, cases, round(cases / sum(cases) OVER (PARTITION BY query_id), 4) AS share FROM c""",
    "metrics_by_mode": METRICS_BY_MODE,
    "alpha_sweep": ALPHA_SWEEP,
    "metrics_by_mode_full": METRICS_FULL,
    "ablation_table": f"""WITH m AS ({METRICS_FULL}), u AS (UNPIVOT (SELECT mode, recall_1, recall_5, recall_10, mrr_10, ndcg_10 FROM m) ON recall_1, recall_5, recall_10, mrr_10, ndcg_10 INTO NAME metric VALUE value),
        w AS (SELECT metric, """
    + ", ".join(f"max(CASE WHEN mode = '{m}' THEN value END) AS {m}" for m in ("document", "note", "rrf", "rrf_50", "weighted", "rerank"))
    + """ FROM u GROUP BY metric) SELECT *, greatest(document, note, rrf, rrf_50, weighted, rerank) AS best FROM w""",
    "depth_beta_sweep": DEPTH_BETA_SWEEP,
    "depth_beta_sweep_full": DEPTH_BETA_SWEEP.replace("[10, 15, 20, 30, 50]", "[10, 15, 20, 30, 50, 100]"),
    "pool_ceiling": f"""{_FUSED_SQL}, {_LAST_SQL} SELECT count(*) AS queries, count(*) FILTER (hit) AS found, round(avg(hit::INT), 4) AS recall_100
        FROM (SELECT g.query_id, bool_or(f.case_id IS NOT NULL) AS hit FROM gold_queries g LEFT JOIN rel USING (query_id)
              LEFT JOIN fused f ON f.query_id = g.query_id AND f.case_id = rel.case_id AND f.rank <= 100 GROUP BY g.query_id)""",
}
