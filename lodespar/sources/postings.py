"""The table of postings: partitioned Parquet by month, scanned with pruning."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespar.functions import skills as S
from lodespar.sources.schemas import POSTING, conforms, parsed

SOURCE_VARIABLE, DEFAULT_SOURCE = "POSTINGS_URI", "data/postings.parquet"


def source_uri() -> str:
    return os.environ.get(SOURCE_VARIABLE, DEFAULT_SOURCE)


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("thread_month", F.date_format("thread_date", "yyyy-MM"))


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Postings with displayed skills, a folder per month. Rows are dealt by month and a salt of the id,
    so that a month's size decides how many files it gets, not one task."""
    rows = conforms(with_month(df.withColumn("skills", S.displayed(F.col("skills")))))
    rows.repartition("thread_month", F.pmod(F.xxhash64("comment_id"), F.lit(64))).write.mode(mode).option("compression", "snappy").partitionBy("thread_month").parquet(path)


def write_unsure(df: DataFrame, path: str, key: str = "objectID") -> None:
    """The ids that the rules are not confident about, sorted as strings."""
    df.where("not confident").select(F.col(key).cast("string").alias(key)).orderBy(key).write.mode("overwrite").json(path)


def read(spark: SparkSession, path: str | None = None, view: str | None = "postings") -> DataFrame:
    """Postings, also as a view for SQL with bound parameters."""
    df = spark.read.schema(parsed(POSTING)).parquet(path or source_uri())
    if view:
        df.createOrReplaceTempView(view)
    return df


def query(spark: SparkSession, sql: str, **parameters) -> DataFrame:
    """SQL with named parameters (``:name``)."""
    return spark.sql(sql, args=parameters)
