import json
import uuid

import pytest
from pyspark.sql import functions as F

from caselode.functions import json_repair as J, text as T


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text, age", [("18 months", 0), ("16-year-old", 16), ("1985", None), ("Not specified", None), ("70", 70), ("aged 36 years", 36), ("3 weeks", 0), (None, None), ("", None), ("121", None), ("120", 120)])
def test_age(spark, text, age):
    assert one(spark, T.normalize_age, text) == age


@pytest.mark.parametrize("text, sex", [("Gentleman", "male"), (" trans woman ", "female"), ("x", "unknown"), (None, "unknown"), ("F", "female")])
def test_sex(spark, text, sex):
    assert one(spark, T.normalize_sex, text) == sex


def test_age_band(spark):
    assert [one(spark, T.age_band, a, "int") for a in (None, 0, 39, 40, 120)] == ["unknown", "0-9", "30-39", "40-49", "120-129"]


def test_outcome_precedence_and_tail(spark):
    o = lambda doc, end=None: spark.createDataFrame([(doc, end)], "d string, e string").select(T.outcome_class(F.col("d"), F.col("e")).alias("o")).first()["o"]
    pad = "plain words " * 40
    assert o(pad + "The patient improved but died.") == "deceased"
    assert o("The patient died. " + pad) == "unknown"
    assert o(pad, "symptoms worsening and recovery") == "deteriorated"
    assert o(pad + "recovered fully") == "improved"
    assert o(pad + "deathly pale") == "unknown"
    assert o(None) == "unknown"


def test_cleaning(spark):
    dirty = " \x07a  b\tc\n\n\n\nd [** name **] XXXXX co-\nöp é-\nf  "
    assert one(spark, T.clean_layout, dirty) == "a b\tc\n\nd [REDACTED] [REDACTED] coöp éf"
    assert one(spark, T.clean_text, "ﬁne") == "fine"
    assert one(spark, T.clean_text, None) is None
    assert one(spark, T.word_count, " a b\n c ") == 3 and one(spark, T.word_count, "") == 0 and one(spark, T.word_count, None) is None


def test_point_id(spark):
    for name in ("acn-12345", "acn-1", "é"):
        assert one(spark, T.uuid5_dns, name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_labels_and_predicates(spark):
    assert [one(spark, T.match_label, s, "double") for s in (1.7, 0.5, 0.34, 0.2, -1.0)] == ["high", "high", "moderate", "weak", "weak"]
    assert one(spark, T.unusual_unicode, "a一") is True and one(spark, T.unusual_unicode, "é") is False
    assert one(spark, lambda c: T.is_empty_value(c), "null") is False and one(spark, lambda c: T.is_empty_value(c, True), " NULL ") is True


@pytest.mark.parametrize(
    "text, status, value",
    [
        ('{"a": 1}', "ok", {"a": 1}), ('"{\\"a\\": 1}"', "ok", {"a": 1}), ('{"a": 1,}', "repaired", {"a": 1}), ('{"a": [1, 2,], "b": "x\ny"}', "repaired", {"a": [1, 2], "b": "x y"}),
        ('{"a": "so-called "half" year", "b": 2}', "repaired", {"a": 'so-called "half" year', "b": 2}), ('{"a": {"b": [1, {"c": "d', "repaired", {"a": {"b": [1, {"c": "d"}]}}),
        ('```json\n{"a": 1}\n```', "repaired", {"a": 1}), ("[]", "failed", None), ("None", "failed", None), ("", "failed", None), (None, "failed", None), ("[1]", "failed", None),
    ],
)
def test_repair(spark, text, status, value):
    got = one(spark, J.parsed, text)
    assert got["status"] == status and (got["json"] is None if value is None else json.loads(got["json"]) == value)


@pytest.mark.parametrize(
    "text, value",
    [
        ('{"a": {"b": 1}, "c": [tru', {"a": {"b": 1}}), ('{"a": "x", "b', {"a": "x"}), ('{"a": "x", "b":', {"a": "x"}), ('{"a": [{"b": "x"}, {"c', {"a": [{"b": "x"}]}),
        ('so: {"a": 1} as asked', {"a": 1}), ('{"a": "say \\"x\\" now",}', {"a": 'say "x" now'}), ('{"a": "{[",}', {"a": "{["}), ("{", None), ('{"a"', None), ("x" * 70000 + "{", None),
    ],
)
def test_repair_of_cut_texts(spark, text, value):
    got = one(spark, J.parsed, text)["json"]
    assert (json.loads(got) if got else None) == value


def test_prune(spark):
    texts = ['{"a": " x ", "b": "N/A", "c": {"d": []}, "e": [null, "-", {"f": 0}]}', '{"a": "none"}', None, "{", '{"none": 1, " k": "\\n y\\t", "q": "a \\"null\\" b", "l": [[], [""], false, ["x", null, null, "y"]]}', '{"a": {"b": {"c": {"d": [[{"e": "Unknown"}]]}}}}']
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(J.parsed(F.col("s")).alias("p")).select("p.*").collect()
    assert [r["status"] for r in rows] == ["ok", "ok", "failed", "failed", "ok", "ok"]
    assert [json.loads(r["json"]) if r["json"] else None for r in rows] == [
        {"a": "x", "e": [{"f": 0}]}, {}, None, None, {"none": 1, " k": "y", "q": 'a "null" b', "l": [False, ["x", "y"]]}, {},
    ]
