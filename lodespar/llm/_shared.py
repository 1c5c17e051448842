"""What the operators of this subpackage have in common.

``materialize`` cuts lineage with a Parquet table in the shared folder that the cluster names in
``spark.checkpoint.dir``. A table (rather than ``DataFrame.checkpoint``) is computed once, survives
the loss of any executor, keeps column pruning, and tells Catalyst its size, so that later joins
broadcast it only when it really is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Buckets (a power of two) that are summed up together.
STRETCH = 10


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes see. Only a local master may fall back to a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        folder = tempfile.mkdtemp(prefix="lodespar-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lodespar/{spark.sparkContext.applicationId}"


_SCOPE: ContextVar[str] = ContextVar("scope", default="")


@contextmanager
def scoped(name: str):
    """Tables written inside have ``name`` before their labels, for ``forget``."""
    token = _SCOPE.set(f"{name}-")
    try:
        yield
    finally:
        _SCOPE.reset(token)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{_SCOPE.get()}{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *scopes: str) -> None:
    """Delete what was written in these scopes.

    Only the caller knows when no DataFrame over them will be read again; a pipeline calls this
    once a stage's result has been written.
    """
    free_shuffles(spark)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if any(name.startswith(f"{scope}-") for scope in scopes):
            fs.delete(status.getPath(), True)


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that nothing refers to any more. It does so when the driver's
    garbage is collected, which a driver with little to do may put off for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def own(df: DataFrame, *without: str) -> list[Column]:
    """The caller's columns, whatever signs are in their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in without]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def source_key(column: str = "source") -> Column:
    """A non-null key that sorts sources (or tells ids apart) by code point, null last."""
    c = F.col(column).cast("string")
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c))


def seeded_hash(seed: int, *columns: Column) -> Column:
    """60 well-mixed bits of the row, the same on any engine that has md5."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def row_hash(seed: int) -> Column:
    """A seeded hash of a document's id and text: rows that share a null id do not share it."""
    return seeded_hash(seed, F.col("doc_id"), F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))


def bucket_bits(rows: int, per_bucket: int = 512, most: int = 30) -> int:
    """How many leading bits of a 60-bit hash cut ``rows`` into buckets of about ``per_bucket``."""
    return min(most, max(0, (max(rows, 1) // per_bucket).bit_length()))


def running(df: DataFrame, group: list[str], bucket: str, order: list[Column], rank: str, weight: str | None = None, start: str | None = None) -> DataFrame:
    """Rank (from 0) and exclusive running weight of each row in its group, without a task per group.

    ``bucket`` (whole numbers) must be monotone in ``order``. Rows are ordered inside (group, bucket) only;
    what precedes a bucket comes from one row per (group, bucket), summed up in stretches of 2**STRETCH
    buckets and then over those, so a group may hold any share of the rows. ``group`` columns must not
    be null.
    """
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    per = df.groupBy(*group, bucket).agg(*sums).withColumn("_s", F.shiftright(F.col(bucket).cast("long"), STRETCH))
    exclusive = lambda c, by: F.coalesce(F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ["n", "w"] if weight else ["n"]
    # Two levels: buckets within a stretch of buckets, then the stretches.
    within, whole = Window.partitionBy(*group, "_s").orderBy(bucket), Window.partitionBy(*group, "_s")
    per = per.select(*group, bucket, "_s", *[exclusive(f"_{c}", within).alias(f"_{c}i") for c in parts], *[F.sum(f"_{c}").over(whole).alias(f"_{c}t") for c in parts])
    over = Window.partitionBy(*group).orderBy("_s")
    tops = per.groupBy(*group, "_s").agg(*[F.max(f"_{c}t").alias(f"_{c}t") for c in parts])
    tops = tops.select(*group, "_s", *[exclusive(f"_{c}t", over).alias(f"_{c}o") for c in parts])
    offsets = per.join(tops, [*group, "_s"]).select(*group, bucket, *[(F.col(f"_{c}i") + F.col(f"_{c}o")).alias(f"_{c}0") for c in parts])
    offsets = materialize(offsets, "offsets")
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    df = df.withColumn("_r", F.row_number().over(inside))
    if weight:
        df = df.withColumn("_s", F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.join(offsets, [*group, bucket]).withColumn(rank, F.col("_n0") + F.col("_r") - 1)
    if weight:
        df = df.withColumn(start, F.col("_w0") + F.col("_s"))
    return df.drop("_r", "_n0", "_s", "_w0")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
