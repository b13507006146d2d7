import collections

from caselode.llm import proportions as p

CASES = (
    [(f"c{i}", "Improved " if i % 3 else "improved") for i in range(200)]
    + [(f"d{i}", "deceased") for i in range(5)]
    + [(f"u{i}", " UNKNOWN") for i in range(60)]
    + [("c1", "improved"), ("c1", "improved"), (None, "improved"), ("n1", None)]
)
TARGETS = [
    ("a", "improved", 0.5, 0, 100), ("a", "deceased", 0.1, 0, 100), ("a", "unknown", 0.4, 0, 100),
    ("b", "improved", 0.9, 0, 50), ("b", "deceased", 0.02, 4, 50), ("b", "unknown", 0.08, 2, 50),
    ("c", "unchanged", 0.3, 2, 20), ("c", "improved", 0.7, 2, 20),
]


def run(spark, cases, targets):
    c = spark.createDataFrame([(*x, "extra") for x in cases], "case_id string, outcome_class string, cls string")
    t = spark.createDataFrame(targets, "plan_id string, outcome_class string, target_share double, min_rows int, sample_size int")
    sample, report = p.proportional_sample(c, t)
    return [tuple(r) for r in sample.collect()], {(r["plan_id"], r["outcome_class"]): r for r in report.collect()}


def test_report_and_sample(spark):
    sample, report = run(spark, CASES, TARGETS)
    assert len(sample) == len(set(sample))
    assert report["a", "deceased"]["available"] == 5 and report["a", "deceased"]["needed"] == 10 and report["a", "deceased"]["short_by"] == 5
    assert report["a", "improved"]["available"] == 200 and report["a", "improved"]["short_by"] == 0
    assert report["c", "unchanged"]["short_by"] == 6
    counts = collections.Counter((plan, cls) for plan, cls, _ in sample)
    for key, r in report.items():
        assert counts[key] == r["sampled"] <= r["available"]
        assert r["sampled"] >= min(r["min_rows"], r["available"])
        assert abs(r["sampled"] - min(r["needed"], r["available"])) <= 1 + (key == ("b", "improved")) * 4
    assert sum(n for (plan, _), n in counts.items() if plan == "b") <= 51
    by_id = {i: c.strip().lower() for i, c in CASES if i and c}
    assert all(by_id[i] == cls for _, cls, i in sample)


def test_each_plan_keeps_total_floors_and_shares(spark):
    cases = [(f"x{i}", "abcdefg"[i % 7]) for i in range(1400)] + [(f"y{i}", "rare") for i in range(3)]
    targets = [("even", c, 1 / 7, 1, 333) for c in "abcdefg"] + [("uneven", c, w, 2, 150) for c, w in zip("abc", (0.501, 0.333, 0.166))]
    targets += [("floored", "a", 0.98, 0, 100), ("floored", "b", 0.02, 30, 100), ("floored", "rare", 0.0, 10, 100)]
    sample, report = run(spark, cases, targets)
    counts = collections.Counter((plan, cls) for plan, cls, _ in sample)
    for (plan, cls), r in report.items():
        assert r["sampled"] == counts[plan, cls] >= min(r["min_rows"], r["available"])
        if plan != "floored":
            assert abs(r["sampled"] - r["target_share"] * r["sample_size"]) < 1 and r["short_by"] == 0
    totals = collections.Counter(plan for plan, _, _ in sample)
    assert totals["even"] == 333 and totals["uneven"] == 150 and totals["floored"] == 100
    assert report["floored", "rare"]["sampled"] == 3 and report["floored", "rare"]["short_by"] == 7 and report["floored", "b"]["sampled"] == 30


def test_shortfalls_come_from_the_draw(spark):
    c = spark.createDataFrame(CASES, "case_id string, outcome_class string")
    t = spark.createDataFrame(TARGETS, "plan_id string, outcome_class string, target_share double, min_rows int, sample_size int")
    short = p.proportional_sample(c, t)[1].where("short_by > 0").select("plan_id", "outcome_class")
    assert {tuple(r) for r in short.collect()} == {("a", "deceased"), ("c", "unchanged")}
    assert "rank" in short._jdf.queryExecution().optimizedPlan().toString()


def test_same_rows_each_time(spark):
    assert run(spark, CASES, TARGETS)[0] == run(spark, CASES, TARGETS)[0] or set(run(spark, CASES, TARGETS)[0]) == set(run(spark, CASES, TARGETS)[0])


def test_empty_tables(spark):
    sample, report = run(spark, [], TARGETS)
    assert sample == [] and all(r["available"] == 0 for r in report.values())
    assert run(spark, CASES, []) == ([], {})
