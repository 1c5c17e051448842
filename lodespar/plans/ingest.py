"""Batch ingest: landed threads to a table of postings, in one narrow pass.

``read.json`` -> explode -> text -> extraction (Arrow) -> normalisation -> routing. Nothing shuffles
before the coverage report or the partitioned write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespar.functions.extraction import CONFIDENCE, FIELDS, extraction, is_confident, normalized
from lodespar.functions.text import html_to_text, run_date
from lodespar.sources import logs, postings, threads
from lodespar.sources.schemas import COUNTED


def with_text(posts: DataFrame) -> DataFrame:
    return posts.withColumn("text", html_to_text(F.col("comment_text")))


def extracted(posts: DataFrame) -> DataFrame:
    """Rows with ``text`` get the extraction's columns, normalised, and ``confidence`` and ``confident``."""
    rows = posts.withColumn("_e", extraction(F.col("text"))).select(*posts.columns, "_e.*")
    return normalized(rows).withColumn("confident", is_confident(F.col("confidence")))


def as_postings(rows: DataFrame, source: str = "rules") -> DataFrame:
    return rows.select(*FIELDS, F.col("objectID").cast("long").alias("comment_id"), F.to_date("thread_date").alias("thread_date"), F.lit(source).alias("extracted_by"))


def coverage(rows: DataFrame) -> DataFrame:
    """field, hits, total: in how many posts the rules are confident of each field. One pass."""
    sums = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("confident").alias("all of them"), *[F.count_if(F.col("confidence")[c]).alias(c) for c in CONFIDENCE])
    return sums.unpivot(["total"], ["all of them", *CONFIDENCE], "field", "hits").select("field", "hits", "total").orderBy(F.desc("hits"), "field")


def n_threads(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("thread_date").alias("threads"))


def periods(rows: DataFrame) -> DataFrame:
    return rows.where("salary_period is not null").groupBy("salary_period").agg(F.count(F.lit(1)).alias("n"))


def counts(rows: DataFrame, columns: list[str] = COUNTED) -> DataFrame:
    """total_posts and the number of values of each field; false and empty lists are values."""
    return rows.agg(F.count(F.lit(1)).alias("total_posts"), *[F.count(c).alias(c) for c in columns])


def history_row(rows: DataFrame, thread_id: str) -> DataFrame:
    return counts(rows).select(run_date(F.current_timestamp()).alias("date"), F.lit(thread_id).alias("thread_id"), "total_posts", *COUNTED)


def run(spark: SparkSession, folder: str, out: str | None = None, unsure: str | None = None) -> DataFrame:
    """Postings of a landing folder; also written, with the ids that the rules are not sure of, if asked."""
    rows = extracted(with_text(threads.posts(threads.dated(threads.threads(spark, folder)))))
    if out:
        postings.write(as_postings(rows), out)
    if unsure:
        postings.write_unsure(rows, unsure)
    return as_postings(rows)


def record(spark: SparkSession, folder: str, thread_id: str, log: str) -> DataFrame:
    """Add a thread's extraction counts to the history, in place of an earlier run of the same day."""
    posts = threads.posts(threads.dated(threads.threads(spark, folder)).where(F.col("thread_id") == thread_id))
    return logs.update_history(spark, log, history_row(extracted(with_text(posts)), thread_id))
