"""Questions about postings: jobs, trends, matches, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespar.functions import skills as S
from lodespar.functions.vocabulary import REMOTE

JOB_COLUMNS = ["comment_id", "company", "location", "remote", "salary_min", "salary_max", "salary_period", "seniority", "skills", "thread_month"]
LEAST_MATCHED = 2


def _within(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value}")


def health(postings: DataFrame) -> DataFrame:
    return postings.agg(F.count(F.lit(1)).alias("postings"))


def status(read, source: str) -> dict:
    """Health as an answer that never raises; ``read`` gives the postings."""
    try:
        return {"status": "ok", "postings": health(read()).first()[0], "source": source}
    except Exception as e:  # any fault of the source is the answer
        return {"status": "degraded", "reason": str(e), "source": source}


def postings_per_month(postings: DataFrame, month: str = "thread_month") -> DataFrame:
    return postings.groupBy(month).agg(F.count(F.lit(1)).alias("n"))


def with_month_total(postings: DataFrame, month: str = "thread_month") -> DataFrame:
    """Each posting with ``n``, its month's number of postings: the counts (a row a month) are joined back, so that
    no month is one task's."""
    return postings.join(postings_per_month(postings, month), month)


def in_latest_month(postings: DataFrame, month: str = "thread_month") -> DataFrame:
    """The rows of the greatest month: one pass for its name, which then prunes the scan's partitions."""
    newest = postings.agg(F.max(month).alias(month))
    return postings.join(F.broadcast(newest), month, "left_semi")


def jobs(postings: DataFrame, month: str | None = None, skill: str | None = None, remote: str | None = None, min_salary: int | None = None, limit: int = 50, columns: list[str] | None = None) -> DataFrame:
    """Postings of a month (the latest if none is given), best paid first, unknown pay last."""
    _within("limit", limit, 1, 500)
    if remote is not None and remote not in REMOTE:
        raise ValueError(f"remote must be one of {REMOTE}")
    if min_salary is not None and min_salary < 0:
        raise ValueError("min_salary must not be negative")
    rows = postings.where(F.col("thread_month") == month) if month else in_latest_month(postings)
    if skill:
        rows = rows.where(F.array_contains("skills", skill))
    if remote:
        rows = rows.where(F.col("remote") == remote)
    if min_salary is not None:
        rows = rows.where(F.col("salary_min") >= min_salary)
    return rows.select(*(columns or JOB_COLUMNS)).orderBy(F.col("salary_max").desc_nulls_last(), "comment_id").limit(limit)


def trends(postings: DataFrame, skills: list[str], limit_months: int = 24) -> DataFrame:
    """thread_month, skill, postings, share: how many of a month's postings name each skill, for the
    last months in which any does."""
    _within("limit_months", limit_months, 1, 120)
    wanted = list(dict.fromkeys(s.strip() for s in skills if s.strip()))
    if not wanted:
        raise ValueError("no skills given")
    # One pass: a month's total and its count of each asked-for skill. Nothing is exploded before the
    # aggregation, whose shuffle carries a row for each month and task.
    times = lambda s: F.when(F.array_contains("skills", s), F.size(F.filter("skills", lambda x: x == s))).otherwise(0)
    wide = postings.groupBy("thread_month").agg(F.count(F.lit(1)).alias("_total"), *[F.sum(times(s)).alias(f"_{i}") for i, s in enumerate(wanted)])
    points = F.explode(F.array(*[F.struct(F.lit(s).alias("skill"), F.col(f"_{i}").alias("postings")) for i, s in enumerate(wanted)]))
    counts = wide.select("thread_month", "_total", points.alias("x")).select("thread_month", "_total", "x.*").where("postings > 0")
    share = F.round(F.col("postings") / F.col("_total"), 4)
    recent = F.dense_rank().over(Window.orderBy(F.desc("thread_month")))
    return counts.withColumn("share", share).withColumn("_rank", recent).where(F.col("_rank") <= limit_months).select("thread_month", "skill", "postings", "share").orderBy("thread_month", "skill")


def trend_grid(points: DataFrame) -> DataFrame:
    """Every month with every skill, 0 where there is no point. Both lists are short."""
    grid = points.select("thread_month").distinct().crossJoin(points.select("skill").distinct())
    return grid.join(points, ["thread_month", "skill"], "left").select("thread_month", "skill", F.coalesce("share", F.lit(0.0)).alias("share"))


def top_skills(postings: DataFrame, n: int = 20) -> DataFrame:
    """thread_month, skill, n: the commonest pairs; ties by month and skill."""
    counts = postings.select("thread_month", F.explode("skills").alias("skill")).groupBy("thread_month", "skill").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "thread_month", "skill").limit(n)


def idf(postings: DataFrame, skills: str = "skills") -> DataFrame:
    """skill, weight = ln((n + 1) / (count + 1)) + 1, over postings with distinct canonical skills."""
    n = postings.agg(F.count(F.lit(1)).alias("_n"))
    counts = postings.select(F.explode(skills).alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("_c"))
    return counts.crossJoin(F.broadcast(n)).select("skill", (F.log((F.col("_n") + 1) / (F.col("_c") + 1)) + 1).alias("weight"))


def overlap(wanted: Column, mine: list[str]) -> tuple[Column, Column]:
    """(matched, missing) of a posting's skills, sorted."""
    own = F.array(*map(F.lit, mine)).cast("array<string>")
    return F.array_sort(F.array_intersect(wanted, own)), F.array_sort(F.array_except(wanted, own))


def match(postings: DataFrame, mine: list[str], limit: int = 10, canonical: bool = True) -> DataFrame:
    """Postings that name at least two of the skills, by the share of their weight that is matched.

    comment_id, company, score, matched, missing, salary_min, salary_max; the score is exact.
    """
    _within("limit", limit, 1, 50)
    rows = postings.withColumn("_wanted", S.canonical(F.col("skills")) if canonical else F.col("skills"))
    matched, missing = overlap(F.col("_wanted"), mine)
    rows = rows.withColumn("matched", matched).withColumn("missing", missing)
    # Weights count all postings of the month; only those with enough matches are weighed and shuffled.
    weights = idf(rows, "_wanted")
    eligible = rows.where(F.size("matched") >= LEAST_MATCHED)
    lines = eligible.select("comment_id", "company", "matched", "missing", "salary_min", "salary_max", F.explode("_wanted").alias("skill")).join(weights, "skill", "left")
    lines = lines.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    earned = F.sum(F.when(F.array_contains("matched", F.col("skill")), F.col("weight")).otherwise(0.0))
    scored = lines.groupBy("comment_id").agg(*[F.first(c).alias(c) for c in ("company", "matched", "missing", "salary_min", "salary_max")], (earned / F.sum("weight")).alias("score"))
    return scored.select("comment_id", "company", "score", "matched", "missing", "salary_min", "salary_max").orderBy(F.desc("score"), "comment_id").limit(limit)


def match_resume(postings: DataFrame, resume: str, limit: int = 10) -> tuple[list[str], DataFrame]:
    """The resume's skills as shown, and matches in the latest month with rounded scores."""
    if len(resume) < 20:
        raise ValueError("a resume needs at least 20 characters")
    mine = S.in_text_local(resume)
    found = match(in_latest_month(postings), mine, limit)
    shown = found.select("comment_id", "company", F.round("score", 4).alias("score"), S.displayed(F.col("matched")).alias("matched_skills"), S.displayed(F.col("missing")).alias("gap_skills"), "salary_min", "salary_max")
    return S.display_local(mine), shown


def precision_at_k(ranked: DataFrame, relevant: DataFrame, order: list, k: int = 10, key: str = "comment_id") -> DataFrame:
    """One row, precision: the share of the first k that is relevant; 0 without any."""
    marks = relevant.select(key).distinct().withColumn("_hit", F.lit(1.0))
    top = ranked.orderBy(*order).limit(k)
    return top.join(marks, key, "left").agg(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0.0))), F.lit(0.0)).alias("precision"))


def replicated(df: DataFrame, times: int, key: str, step: int = 100_000_000) -> DataFrame:
    """``df`` ``times`` over with distinct keys. An explode, so no row meets another."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(key, F.col(key) + F.col("_copy") * step).drop("_copy")


def searched(df: DataFrame, text: str, columns: list[str] | None = None, **equal) -> DataFrame:
    """Rows that equal the given fields and have ``text`` (any case) in any column."""
    for c, v in equal.items():
        df = df.where(F.col(c) == v)
    shown = F.lower(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns or df.columns]))
    return df.where(shown.contains(text.lower()))


def without_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` without those of the columns that are null in every row."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if not counts[c]])
