import os

import pytest

from caselode.llm import queries as q

SF = "/root/testdata/sf0.001"
NEEDS_DATA = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@NEEDS_DATA
@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got = q.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({q.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)


COLUMNS = {
    "p1_found": "plan_id string, outcome_class string",
    "p2_found": "field_name string, key_a bigint, key_b bigint",
    "p3_found": "limit_id string, row_no bigint",
    "p4_found": "field_name string, row_key bigint, pii_kind string, start_at int",
    "p6_ids": "doc_id bigint, ids array<int>",
    "p7_found": "doc_id bigint, item_id bigint",
    "p8_found": "doc_id bigint",
}


@NEEDS_DATA
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_no_row_twice(spark, name):
    got = q.QUERIES[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == COLUMNS[name]
    rows = [tuple(map(str, r)) for r in got.collect()]
    assert len(rows) == len(set(rows))
