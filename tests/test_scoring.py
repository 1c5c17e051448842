import math

import pytest
from pyspark.sql import functions as F

from lodespar.functions import text as T
from lodespar.operators import sampling, scoring


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_outcomes_and_reports(spark):
    rows = [(1, 1)] * 4 + [(None, None)] * 6
    df = spark.createDataFrame(rows, "p int, t int").withColumn("o", scoring.outcome(F.col("p"), F.col("t"), text=False))
    r = scoring.nullable_report(df, "o").first()
    assert (r.precision, r.hallucination_rate, r.coverage, r.n) == (1.0, 0.0, 0.4, 10)
    df = spark.createDataFrame([(1, 1)] * 4 + [(99, None)] * 6, "p int, t int").withColumn("o", scoring.outcome(F.col("p"), F.col("t"), text=False))
    r = scoring.nullable_report(df, "o").first()
    assert (r.precision, r.hallucination_rate) == (0.4, 0.6)
    r = scoring.nullable_report(df.where("false"), "o").first()
    assert (r.precision, r.precision_low, r.precision_high) == (0.0, 0.0, 1.0)
    text = spark.createDataFrame([("", None), ("", "a"), ("a", ""), ("a", "b")], "p string, t string")
    assert [x.o for x in text.select(scoring.outcome(F.col("p"), F.col("t")).alias("o")).collect()] == ["abstained", "missed", "hallucinated", "wrong"]


def test_wilson(spark):
    low, high = (value(spark, c) for c in scoring.wilson(F.lit(84), F.lit(100)))
    assert (low, high) == (pytest.approx(0.7554, abs=2e-3), pytest.approx(0.8973, abs=2e-3))
    assert [value(spark, c) for c in scoring.wilson(F.lit(0), F.lit(0))] == [0.0, 1.0]
    for k, n in ((0, 5), (5, 5), (1, 1000)):
        low, high = (value(spark, c) for c in scoring.wilson(F.lit(k), F.lit(n)))
        assert 0 <= low <= high <= 1


def test_set_scores(spark):
    rows = [(["K8s"], ["kubernetes"]), ([], []), (["a"], []), (["a", "b"], ["b", "c", "d"])]
    df = spark.createDataFrame(rows, "p array<string>, t array<string>").select(scoring.set_scores(F.col("p"), F.col("t")).alias("s"))
    got = [tuple(r.s) for r in df.collect()]
    assert got[:3] == [(1.0, 1.0, 1.0), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)]
    assert got[3] == pytest.approx((0.5, 1 / 3, 0.4))


def test_enums_count_null_as_a_class(spark):
    df = spark.createDataFrame([("remote", "remote"), (None, None), ("onsite", None), ("hybrid", "remote")], "t string, p string")
    m = scoring.confusion(df, "t", "p")
    assert scoring.accuracy(m).first().accuracy == 0.5
    assert {r.truth: r.recall for r in scoring.class_recall(m).collect()} == {"remote": 1.0, "None": 1.0, "onsite": 0.0, "hybrid": 0.0}


def test_dice(spark):
    like = lambda a, b: value(spark, T.dice(F.lit(a), F.lit(b)))
    assert like("San Francisco, CA", "San Francisco") == pytest.approx(0.857, abs=1e-3)
    assert like("A", "a ") == 1 and like("a", "b") == 0 and like("aaaa", "aa") == pytest.approx(0.5) and like(None, "") == 1


def test_percentiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 54)], "v double")
    r = scoring.latencies(df, "v").first()
    assert (r.n, r.p50, r.p95, r.p95_nearest) == (53, 27.0, 50.0, 51.0)
    assert scoring.latencies(spark.createDataFrame([(3.0,)], "v double"), "v").first().p95 == 3.0


def test_costs(spark):
    usage = spark.createDataFrame([("C", 100, 10, 30, 20), ("C", 50, 5, 0, 0), ("D", 10, 1, 20, 0)], "config string, input_tokens long, output_tokens long, cache_read long, cache_write long")
    got = {r.config: r for r in scoring.cost(scoring.tokens(usage, ["config"]), {"input": 1.0, "output": 10.0}).collect()}
    assert (got["C"].input, got["C"].usage_missing, got["C"].cost_usd) == (100, False, (100 + 150) / 1e6) and got["D"].usage_missing
    ok = lambda *x: value(spark, scoring.cost_complete(*map(F.lit, x)))
    assert ok("F", 0, False, 0) and not ok("C", 0, False, 0) and not ok("C", 3, True, 0) and not ok("C", 3, False, 1)


def test_checks_raise(spark):
    df = spark.createDataFrame([(1.5, 1, 0.2, 0.1)], "p double, n int, lo double, hi double")
    for bad in ({"proportions": ["p"]}, {"intervals": [("lo", "hi")]}):
        with pytest.raises(Exception, match="out of bounds"):
            scoring.checked(df, **bad).collect()
    assert scoring.checked(df, counts=["n"]).count() == 1


@pytest.mark.parametrize("n,oversample", [(60, {}), (80, {"prose": 18}), (40, {}), (9, {})])
def test_allocation(n, oversample):
    available = {"pipe/has_salary/long": 67, "pipe/no_salary/long": 133, "pipe/no_salary/short": 133, "pipe/has_salary/short": 67, "prose/no_salary/long": 20, "prose/no_salary/short": 20, "prose/has_salary/long": 10, "prose/has_salary/short": 10}
    take = sampling.allocate(available, n, oversample)
    assert all(1 <= take[k] <= available[k] for k in available)
    assert sum(take.values()) == n or (n == 9 and sum(take.values()) == 16)
    for part, goal in oversample.items():
        assert sum(v for k, v in take.items() if part in k.split("/")) >= goal


def test_drawing_is_reproducible(spark):
    df = spark.range(460).select(F.col("id"), F.when(F.col("id") < 400, "pipe").otherwise("prose").alias("stratum"))
    a, b = (sampling.draw(x, 60, "id") for x in (df, df.repartition(7)))
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 60 and a.select("id").distinct().count() == 60
    assert {r.split: r["count"] for r in sampling.split(a, "id").groupBy("split").count().collect()} == {"dev": 40, "held-out": 20}
    power = {r.value: r for r in sampling.slice_power(a, ["stratum"]).collect()}
    assert power["pipe"].verdict == "usable" and math.isclose(sum(r.n for r in power.values()), 60)


def test_allocation_by_cases():
    """Small strata whose shares are worked out by hand."""
    assert sampling.allocate({}, 10) == {}
    assert sampling.allocate({"a": 50, "b": 50}, 10) == {"a": 5, "b": 5}
    assert sampling.allocate({"a": 97, "b": 3}, 10) == {"a": 8, "b": 2}  # the floor of two, paid for by the largest that may shrink
    assert sampling.allocate({"a": 3, "b": 1}, 10) == {"a": 3, "b": 1}  # all there is
    boosted = sampling.allocate({"x/a": 90, "y/a": 30, "x/b": 12, "y/b": 8}, 20, {"b": 15})
    assert boosted["x/b"] + boosted["y/b"] == 15 and boosted["x/b"] == 12 and sum(boosted.values()) == 20


def test_split_at_any_share(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("split_before"))
    ranked = [r.id for r in df.orderBy(sampling.shuffle_key(sampling.SEED + 1, "id"), "id").collect()]
    for share in (0, 0.001, 0.5, 1):
        got = {r.id for r in sampling.split(df, "id", share).where("split = 'dev'").collect()}
        assert got == set(ranked[: round(3000 * share)])
    assert sampling.split(df.where("false"), "id").count() == 0


def test_ladder_reports(spark, tmp_path):
    rows = [("1", "B", "wrong", "extracted", 1.0, "a", "a"), ("1", "C", "wrong", "missed", 1.0, "a", "a"), ("2", "B", "extracted", "abstained", 0.5, "a", None), ("2", "C", "extracted", "abstained", 1.0, "a", "a")]
    df = spark.createDataFrame(rows, "comment_id string, config string, company string, salary string, f1 double, t string, p string")
    enum = F.struct(F.col("t").alias("truth"), F.col("p").alias("predicted"))
    df = df.select("comment_id", "config", "company", "salary", F.lit("extracted").alias("location"), F.struct("f1").alias("skills"), enum.alias("remote"), F.struct(F.col("t").alias("truth"), F.col("t").alias("predicted")).alias("seniority"))
    groups = scoring.disagreement_groups(df)
    assert sorted(tuple(r) for r in groups.collect()) == [("company", "B,C", "1"), ("remote", "B", "2"), ("salary", "C", "1"), ("skills", "B", "2")]
    off = scoring.disagreements(df, ["B", "C"])
    scoring.write_ladder(spark, f"{tmp_path}/out", [{"config": "B", "cost_usd": 0.5, "scores": {}}, {"config": "C", "cost_usd": None, "scores": {}}], off, groups)
    text = (tmp_path / "out/ladder.md").read_text()
    assert "| B | 0.5 |" in text and "| company | B,C | 1 |" in text
    import json

    assert {r["field"]: (r["B"], r["C"]) for r in json.loads((tmp_path / "out/ladder.json").read_text())["disagreements"]}["salary"] == (0, 1)
    table = spark.createDataFrame([("B", 0.4), ("C", None), ("D", 0.9)], "config string, p double")
    assert [r.config for r in scoring.sorted_rungs(table, "p").collect()] == ["B", "D", "C"]
    assert [r.config for r in scoring.sorted_rungs(table, "p", True).collect()] == ["D", "B", "C"]
