import json

from hypothesis import given, settings, strategies as st

from caselode.operators import nested

ROWS = [
    (1, json.dumps({"symptoms": [{"name of symptom": "cough", "location": "chest"}, "not specified", None], "visit motivation": "cough"})),
    (2, json.dumps({"Symptoms": {"Name of Symptom": "fever", "name_of_symptom": "high fever"}})),
    (3, json.dumps({"Symptoms": [{"name of symptom": "pain", "ordinal": 4, "evolution": [{"when": "now"}]}]})),
    (4, json.dumps({"diagnosis_tests": {"panels": {"1": {"v": 1}, "2": {"v": 2}}}, "patient medical history": {"allergies": ["dust", ["pollen"]]}})),
]

_KEYS = st.sampled_from(["a", "b c", "D", "1", "é"])
_LEAVES = st.one_of(st.none(), st.booleans(), st.integers(-5, 10**9), st.sampled_from([1.5, -0.25, 36.6]), st.sampled_from(["", "x", 'q"q', "ü\n", "null", "[]"]))
_TREES = st.recursive(_LEAVES, lambda inner: st.one_of(st.lists(inner, max_size=3), st.dictionaries(_KEYS, inner, max_size=3)), max_leaves=12)
_OBJECTS = st.dictionaries(_KEYS, _TREES, max_size=4)


def test_child_table_joins_spellings_and_infers_columns(spark):
    df = spark.createDataFrame(ROWS, "line_no long, summary string")
    tables = nested.flat_tables(df, "line_no", "summary")
    got = tables["symptoms"]
    assert got.columns == ["line_no", "node_id", "parent_id", "node_path", "parent_path", "ordinal", "attribute_ordinal", "location", "name_of_symptom", "value"]
    rows = {(r["line_no"], r["node_path"]): r for r in got.collect()}
    assert {k for k, _ in rows} == {1, 2, 3} and rows[1, "symptoms/0"]["location"] == "chest" and rows[3, "Symptoms/0"]["attribute_ordinal"] == "4"
    assert rows[2, "Symptoms"]["name_of_symptom"] == "fever; high fever"
    assert rows[1, "symptoms/1"]["value"] == "not specified" and rows[1, "symptoms/2"]["value"] is None
    assert tables["symptoms/evolution"].collect()[0]["when"] == "now"
    assert tables["diagnosis tests/panels/#"].count() == 2
    schema = nested.merged_schema(df, "line_no", "summary")
    assert nested.child_table(nested.node_rows(df, "line_no", "summary", schema), schema, "absent", "line_no").count() == 0


def test_every_row_hangs_on_its_parent(spark):
    rows = {(r["line_no"], r["node_path"]): r for r in nested.node_rows(spark.createDataFrame(ROWS, "line_no long, summary string"), "line_no", "summary").collect()}
    extra = {(1, ""), (2, ""), (3, ""), (4, ""), (1, "symptoms/1"), (1, "symptoms/2"), (4, "patient medical history/allergies/0"), (4, "patient medical history/allergies/1/0")}
    assert extra <= set(rows)
    assert rows[1, ""]["attributes"] == {"visit motivation": "cough"} and rows[1, ""]["parent_id"] is None
    assert rows[4, "patient medical history/allergies/1/0"]["attributes"] == {"value": "pollen"}
    for (line, path), r in rows.items():
        if path:
            assert r["parent_id"] == rows[line, r["parent_path"]]["node_id"]


def leaves(value, path=""):
    """(path of the row, attribute, value) of every leaf; lists without items count as "[]"."""
    holds = lambda v: isinstance(v, dict) or (isinstance(v, list) and v)
    text = lambda v: None if v is None else "[]" if v == [] else v if isinstance(v, str) else json.dumps(v)
    below = lambda k: f"{path}/{k}" if path else str(k)
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, below(k)) if holds(v) else [(path, k, text(v))]
    else:
        for i, v in enumerate(value):
            yield from leaves(v, below(i)) if holds(v) else [(below(i), "value", text(v))]


@settings(max_examples=2, deadline=None)
@given(st.lists(_OBJECTS, min_size=8, max_size=20))
def test_every_leaf_is_found_again(spark, trees):
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "line_no long, summary string")
    rows = nested.node_rows(df, "line_no", "summary").collect()
    got = sorted(((r["line_no"], r["node_path"], a, v) for r in rows for a, v in r["attributes"].items()), key=repr)
    assert got == sorted(((i, *leaf) for i, t in enumerate(trees) for leaf in leaves(t)), key=repr)
