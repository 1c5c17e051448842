import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodespar.operators import serve
from lodespar.sources import postings as source

ROWS = [
    (1, "Acme", "NYC", "remote", 180000, 230000, "year", "senior", ["Python", "Terraform", "AWS"], "2026-07"),
    (2, "Globex", "SF", "onsite", 150000, 190000, "year", "mid", ["Python", "React"], "2026-07"),
    (3, "Initech", "Remote", "remote", None, None, None, None, ["Python"], "2026-06"),
]


@pytest.fixture(scope="module")
def postings(spark):
    return spark.createDataFrame(ROWS, "comment_id long, company string, location string, remote string, salary_min long, salary_max long, salary_period string, seniority string, skills array<string>, thread_month string")


def ids(df):
    return [r.comment_id for r in df.collect()]


def test_jobs(postings):
    assert ids(serve.jobs(postings)) == [1, 2]
    assert ids(serve.jobs(postings, month="2026-06")) == [3]
    assert ids(serve.jobs(postings, skill="Terraform")) == [1]
    assert ids(serve.jobs(postings, skill="terraform")) == []
    assert ids(serve.jobs(postings, remote="remote")) == [1]
    assert ids(serve.jobs(postings, min_salary=170000)) == [1]
    assert ids(serve.jobs(postings, month="2026-06", min_salary=0)) == []
    assert serve.jobs(postings).columns == serve.JOB_COLUMNS


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": 501}, {"remote": "moon"}, {"min_salary": -1}])
def test_jobs_arguments(postings, bad):
    with pytest.raises(ValueError):
        serve.jobs(postings, **bad)


def test_trends(postings):
    got = {(r.thread_month, r.skill): (r.postings, r.share) for r in serve.trends(postings, ["Python", " AWS "]).collect()}
    assert got == {("2026-06", "Python"): (1, 1.0), ("2026-07", "Python"): (2, 1.0), ("2026-07", "AWS"): (1, 0.5)}
    assert {r.thread_month for r in serve.trends(postings, ["Python"], 1).collect()} == {"2026-07"}
    with pytest.raises(ValueError):
        serve.trends(postings, [" "])
    grid = {(r.thread_month, r.skill): r.share for r in serve.trend_grid(serve.trends(postings, ["Python", "AWS"])).collect()}
    assert grid["2026-06", "AWS"] == 0


def test_match(postings, spark):
    mine, found = serve.match_resume(postings, "I know Python and Terraform quite well.")
    assert mine == ["Python", "Terraform"]
    first = found.first()
    assert (first.comment_id, first.gap_skills) == (1, ["AWS"])
    with pytest.raises(ValueError):
        serve.match_resume(postings, "Python")
    rows = [(1, ["python", "terraform"]), (2, ["python", "react"]), (3, ["python"]), (4, ["python", "go", "rust", "kafka"])]
    few = spark.createDataFrame([(i, "c", s, None, None) for i, s in rows], "comment_id long, company string, skills array<string>, salary_min long, salary_max long")
    weights = {r.skill: r.weight for r in serve.idf(few).collect()}
    assert weights["terraform"] > weights["python"]
    got = serve.match(few, ["python", "go"]).collect()
    assert [r.comment_id for r in got] == [4] and got[0].missing == ["kafka", "rust"]


def test_precision_at_k(spark):
    ranked = spark.createDataFrame([(i, -i) for i in range(5)], "comment_id long, score int")
    at = lambda relevant, k: serve.precision_at_k(ranked, spark.createDataFrame([(i,) for i in relevant], "comment_id long"), [F.desc("score")], k).first()[0]
    assert at([0, 1], 2) == 1 and at([0], 4) == 0.25 and at([0], 10) == 0.2
    assert serve.precision_at_k(ranked.where("false"), ranked, ["score"]).first()[0] == 0


def test_health(postings):
    assert serve.status(lambda: postings, "here") == {"status": "ok", "postings": 3, "source": "here"}
    assert serve.status(lambda: 1 / 0, "there")["status"] == "degraded"


def test_written_table_is_pruned_by_month(postings, tmp_path, spark):
    full = postings.select("company", F.array(F.lit("Engineer")).alias("role_titles"), "location", "remote", "salary_min", "salary_max", F.lit("USD").alias("salary_currency"), "salary_period", F.array(F.lit("k8s"), F.lit("python")).alias("skills"), "seniority", F.lit(None).cast("boolean").alias("visa_sponsor"), "comment_id", F.to_date(F.concat("thread_month", F.lit("-01"))).alias("thread_date"), F.lit("rules").alias("extracted_by"))
    source.write(full, f"{tmp_path}/p")
    table = source.read(spark, f"{tmp_path}/p")
    assert table.where("comment_id = 1").first().skills == ["Kubernetes", "Python"]
    assert "PartitionFilters: [isnotnull(thread_month" in serve.jobs(table, month="2026-07")._jdf.queryExecution().executedPlan().toString()
    assert source.query(spark, "SELECT count(*) AS n FROM postings WHERE remote = :r", r="remote").first().n == 2
    assert table.first().thread_date.day == 1 and isinstance(table.first().thread_date, dt.date)
    with pytest.raises(ValueError):
        source.write(full.withColumn("surprise", F.lit(1)), f"{tmp_path}/q")
    with pytest.raises(Exception, match="remote"):
        source.write(full.withColumn("remote", F.lit("moon")), f"{tmp_path}/q")


def test_small_tools(postings, spark):
    assert ids(serve.searched(postings, "ACME", ["company", "location"])) == [1]
    assert serve.replicated(postings, 3, "comment_id").select("comment_id").distinct().count() == 9
    assert serve.without_empty(postings.withColumn("x", F.lit(None).cast("int")), ["x", "salary_min"]).columns == postings.columns
