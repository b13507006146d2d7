import json

from caselode.operators import nested

ROWS = [
    (1, '{"a": {"b": [{"c": 1}, 2, [{"d": {}}]]}, "e": "x"}'),
    (2, json.dumps('{"k.1": {"2": {"v": null}}, "empty": [], "p/q": {}}')),
    (3, None),
    (4, "  "),
    (5, '{"a": 1,}'),
    (6, '{"a": {}} tail'),
    (7, '[{"a": {}}]'),
    (8, '"text"'),
    (9, '{"a": {}},{"b": {}}'),
    (10, ' {"é\\"{": {"s": "{[{"}} '),
    (11, "```json\n{}\n```"),
    (12, "null"),
    (13, "{}"),
]


def brute(rows):
    out = set()

    def walk(value, path, parent, key):
        if isinstance(value, dict):
            if path:
                out.add((key, path, parent))
            for k, v in value.items():
                walk(v, f"{path}/{k}" if path else k, path, key)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                walk(v, f"{path}/{i}" if path else str(i), parent, key)

    for key, text in rows:
        try:
            value = json.loads(text)
            value = json.loads(value) if isinstance(value, str) else value
        except (TypeError, ValueError):
            continue
        if isinstance(value, dict):
            walk(value, "", "", key)
    return out


def objects(df):
    return nested.node_rows(df, "line_no", "summary").where("kind = 'object' and level > 0")


def test_node_rows_equal_a_walk_of_each_tree(spark):
    df = spark.createDataFrame(ROWS, "line_no long, summary string")
    got = {tuple(r) for r in objects(df).select("line_no", "node_path", "parent_path").collect()}
    assert got == brute(ROWS)
    assert (1, "a/b/2/0/d", "a/b/2/0") in got and (2, "k.1/2", "k.1") in got


def test_parent_keys_ordinals_and_tables(spark):
    df = spark.createDataFrame(ROWS[:2], "line_no long, summary string")
    by_path = {r["node_path"]: r for r in objects(df).collect()}
    assert by_path["a/b/0"]["parent_id"] == by_path["a"]["node_id"]
    assert by_path["a/b/0"]["ordinal"] == 0 and by_path["a/b/0"]["shape"] == "a/b[]"
    tables = nested.flat_tables(df, "line_no", "summary")
    assert tables["a/b"].where("node_path = 'a/b/0'").select("c").collect()[0]["c"] == "1"
    assert "k.1/#" in tables and "" in tables


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "line_no long, summary string")
    assert nested.node_rows(empty, "line_no", "summary").count() == 0
    assert nested.merged_schema(empty, "line_no", "summary").count() == 0
    twice = spark.createDataFrame([ROWS[0], ROWS[0]], "line_no long, summary string")
    assert objects(twice).count() == 2 * len(brute(ROWS[:1]))


def test_deep_and_long(spark):
    deep = "1"
    for i in range(30):
        deep = '{"k%d": [%s]}' % (i, deep)
    wide = json.dumps({str(i): {"v": "x" * 50} for i in range(2000)})
    df = spark.createDataFrame([(1, deep), (2, wide)], "line_no long, summary string")
    counts = {r["line_no"]: r["count"] for r in objects(df).groupBy("line_no").count().collect()}
    assert counts == {1: 29, 2: 2000}
    last = nested.node_rows(df, "line_no", "summary").where("kind = 'item'").collect()
    assert len(last) == 1 and last[0]["attributes"] == {"value": "1"} and last[0]["level"] == 60


def test_malformed_rows_cost_no_levels(spark):
    df = spark.createDataFrame([(1, "[" * 1000), (2, '{"a": {"b": 1}}'), (3, '{"a": ' * 500)], "line_no long, summary string")
    assert nested.merged_schema(df, "line_no", "summary").agg({"level": "max"}).first()[0] == 1
    assert [r["node_path"] for r in objects(df).collect()] == ["a"]


def test_repeated_keys_extra_columns_and_null_keys(spark):
    rows = [(None, '{"a": {"x": 1}, "a": {"y": 2}}', "n"), (7, '{"n": {}}', "n")]
    df = spark.createDataFrame(rows, "line_no long, summary string, node_path string")
    got = {(r["line_no"], r["node_path"]): r["attributes"] for r in objects(df).collect()}
    assert got == {(None, "a"): {"y": "2"}, (7, "n"): {}}


def test_different_records_have_different_keys(spark):
    rows = [("1", '{"1:a": {}}'), ("11", '{"a": {}}'), ("1:1", '{"a": {}}')]
    ids = [r["node_id"] for r in nested.node_rows(spark.createDataFrame(rows, "line_no string, summary string"), "line_no", "summary").collect()]
    assert len(set(ids)) == len(ids) == 6
