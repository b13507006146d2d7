import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NEEDS_DATA = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 80


@pytest.fixture(scope="module")
def views():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def cells(rows):
    def cell(v):
        if isinstance(v, float):
            return "~" if v != v else f"{v:.9g}"
        return "~" if v is None else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@NEEDS_DATA
@pytest.mark.parametrize("name", ["hybrid_search", "fusion_weighted", "corpus_dedup", "corpus_clean_text", "profile_distribution", "stratified_sample", "cache_hit_rate", "served_version", "event_sessions", "negated_scopes", "metrics_by_mode", "search_thorough", "document_polarity", "explain_fallback", "audit_chain", "summary_leaves", "p5_tables", "ablation_table"])
def test_query_equals_sql(spark, views, name):
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = views.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert cells(tuple(r) for r in got.select(*cols).collect()) == cells(want)


@NEEDS_DATA
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@NEEDS_DATA
def test_nested_contract(spark):
    got = entry.queries()["p5_found"](spark, SF)
    assert got.dtypes == [("line_no", "bigint"), ("node_path", "string"), ("parent_path", "string")]
    rows = [tuple(r) for r in got.collect()]
    assert rows and len(rows) == len(set(rows))
