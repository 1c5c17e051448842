"""Streaming over the landing folder: an extension for continuous arrival.

Threads are write-once files, which suits the file source. Each post is extracted as it lands; counts by
window keep a watermark, so that their state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodespar.plans.ingest import as_postings, extracted, with_text
from lodespar.sources import threads
from lodespar.sources.postings import with_month
from lodespar.sources.schemas import THREAD


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    stream = spark.readStream.schema(THREAD).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return threads.posts(threads.dated(stream))


def postings(spark: SparkSession, folder: str) -> DataFrame:
    return with_month(as_postings(extracted(with_text(arriving(spark, folder)))))


def write(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to the partitioned table; exactly once by the sink's log."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("thread_month").outputMode("append").trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "1 hour", key: str | None = None) -> DataFrame:
    """Events of each kind in tumbling windows; repeats of a key within the watermark count once."""
    rows = events.withWatermark(time, late)
    if key:
        rows = rows.dropDuplicatesWithinWatermark([key])
    return rows.groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")
