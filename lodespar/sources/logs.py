"""Run logs, labels, frozen splits, samples and the extraction history, as JSON lines."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespar.functions.vocabulary import PERIODS, REMOTE, SENIORITY
from lodespar.sources.schemas import COUNTED, HISTORY, LABEL, parsed


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("append").json(path)


def runs(spark: SparkSession, path: str) -> DataFrame | None:
    """Every recorded run; None if there is none yet."""
    return spark.read.json(path) if exists(spark, path) else None


def labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(parsed(LABEL)).json(path)


def checked_labels(df: DataFrame, strict: bool = True) -> DataFrame:
    """Labels with an id, a done mark and values that their fields allow; others raise, or go if not ``strict``."""
    rules = {
        "comment_id": F.col("comment_id").cast("string").rlike(r"^\d+$"),
        "done": F.col("done").isNotNull(),
        "remote": F.col("remote").isNull() | F.col("remote").isin(*REMOTE),
        "seniority": F.col("seniority").isNull() | F.col("seniority").isin(*SENIORITY),
        "salary_period": F.col("salary_period").isNull() | F.col("salary_period").isin(*PERIODS),
        "salary_min": F.col("salary_min").isNull() | (F.col("salary_min") >= 0),
        "salary_max": F.col("salary_max").isNull() | (F.col("salary_max") >= F.coalesce("salary_min", F.lit(0))),
    }
    for name, ok in rules.items():
        if name in df.columns:
            ok = F.coalesce(ok, F.lit(False))
            df = df.where(ok if not strict else F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit(f"bad {name} in label "), F.coalesce(F.col("comment_id").cast("string"), F.lit("?")))).cast("boolean")))
    return df


def done(df: DataFrame) -> DataFrame:
    return df.where(F.col("done"))


def save_labels(df: DataFrame, path: str) -> None:
    df.orderBy(F.col("comment_id").cast("long")).coalesce(1).write.mode("overwrite").json(path)


def frozen_splits(spark: SparkSession, path: str) -> DataFrame:
    """(comment_id, split) of a file with an id list for each split."""
    table = spark.read.json(path, multiLine=True)
    parts = [table.select(F.explode(F.col(f"`{c}`")).alias("comment_id"), F.lit(c).alias("split")) for c in table.columns]
    return reduce(DataFrame.unionByName, parts)


def same_ids(a: DataFrame, b: DataFrame, key: str = "comment_id") -> DataFrame:
    """One row: only_a, only_b, repeated. All zero if both hold the same ids, each once."""
    x, y = a.groupBy(key).agg(F.count(F.lit(1)).alias("_a")), b.groupBy(key).agg(F.count(F.lit(1)).alias("_b"))
    both = x.join(y, key, "full")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(zero(F.col("_b").isNull().cast("int")).alias("only_a"), zero(F.col("_a").isNull().cast("int")).alias("only_b"), zero(((F.col("_a") > 1) | (F.col("_b") > 1)).cast("int")).alias("repeated"))


def labelled(df: DataFrame, splits: DataFrame, split: str | None = None) -> DataFrame:
    """Completed labels of a frozen split (all, tune or its other name dev, held-out). The labels must be
    exactly the frozen ids; the split that a label itself records is ignored."""
    if split not in (None, "all", "dev", "tune", "held-out"):
        raise ValueError(f"unknown split {split!r}")
    complete = done(df)
    if any(same_ids(complete, splits).first()):
        raise ValueError("completed labels and frozen ids differ")
    if split not in (None, "all"):
        splits = splits.where(F.col("split") == ("tune" if split == "dev" else split))
        complete = complete.join(splits.select("comment_id"), "comment_id", "left_semi")
    return complete


def remaining(sample: DataFrame, complete: DataFrame, key: str = "comment_id") -> DataFrame:
    return sample.join(complete, key, "left_anti")


def covered(sample: DataFrame, ids: DataFrame, key: str = "comment_id") -> DataFrame:
    return sample.join(ids, key, "left_semi")


def drafts_to_review(sample: DataFrame, drafts: DataFrame, complete: DataFrame, key: str = "comment_id") -> DataFrame:
    return remaining(covered(sample, drafts, key), complete, key)


def uncertain(df: DataFrame) -> DataFrame:
    return df.where(F.size("uncertain") > 0)


def to_recheck(sample: DataFrame, complete: DataFrame, key: str = "comment_id") -> DataFrame:
    """Rows of the sample whose finished labels leave a field uncertain."""
    return covered(sample, uncertain(complete), key)


def uncertain_fields(df: DataFrame) -> DataFrame:
    """field, n: in how many labels each field is marked uncertain."""
    return df.select(F.explode(F.array_distinct("uncertain")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def progress(sample: DataFrame, complete: DataFrame) -> DataFrame:
    """stratum, total, done."""
    marked = sample.join(complete.select("comment_id").distinct().withColumn("_done", F.lit(True)), "comment_id", "left")
    return marked.groupBy("stratum").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("_done", F.lit(False))).alias("done"))


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(parsed(HISTORY)).json(path)


def upserted(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ("date", "thread_id")) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``, sorted by key as strings."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new).orderBy(*[F.col(k).cast("string") for k in key])


def update_history(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """Replace the rows of the same keys in the log. The new log is written beside the old one and takes
    its place, so a failed write leaves the old."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    rows = upserted(history(spark, path), new) if exists(spark, path) else new.orderBy("date", "thread_id")
    rows.coalesce(1).write.json(beside.toString())
    fs = target.getFileSystem(conf)
    fs.delete(target, True)
    if not fs.rename(beside, target):
        raise OSError(f"cannot put {beside} in place of {target}")
    return history(spark, path)


def valid_history(df: DataFrame) -> DataFrame:
    """Rows with an ISO date and counts between 0 and the total, sorted by date and thread."""
    counts = [c for c in COUNTED if c in df.columns]
    ok = F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("total_posts") >= 0)
    for c in counts:
        ok = ok & F.col(c).between(0, F.col("total_posts"))
    return df.where(ok).orderBy("date", F.col("thread_id").cast("string"))


def latest_totals(df: DataFrame, counts: list[str]) -> DataFrame:
    """Sums of each thread's last row."""
    last = df.groupBy("thread_id").agg(*[F.max_by(c, "date").alias(c) for c in counts])
    return last.agg(*[F.sum(c).cast("long").alias(c) for c in counts])


def trend_table(df: DataFrame, columns: list[str]) -> str:
    """A fixed-width table of the (small) history."""
    rows = [columns] + [[str(v) for v in r] for r in df.select(*columns).orderBy("date", F.col("thread_id").cast("string")).collect()]
    widths = [max(map(len, c)) for c in zip(*rows)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in rows)


def tally(df: DataFrame, buckets: dict[str, str], marks: str = "buckets") -> DataFrame:
    """How many posts carry each of the reader's marks, unmarked shapes included."""
    names = df.sparkSession.createDataFrame(list(buckets.items()), "bucket string, shape string")
    counted = df.select(F.explode(F.array_distinct(marks)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counted, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def spliced(body: str, block: str, start: str = "<!-- tally:start -->", end: str = "<!-- tally:end -->") -> str:
    """``body`` with what stands between the marks replaced, or the block put at its end."""
    if start in body and end in body:
        head, rest = body.split(start, 1)
        return f"{head}{start}\n{block}\n{end}{rest.split(end, 1)[1]}"
    return f"{body.rstrip()}\n\n{start}\n{block}\n{end}\n"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-side text, by the file system of its path, so that any node can read it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, rows: list[dict] | dict, path: str) -> None:
    """A small driver-side result, such as a benchmark's."""
    write_text(spark, path, json.dumps(rows, indent=2, default=str))


def write_sample(sample: DataFrame, path: str, seed: int, rule: str, strata: dict[str, int]) -> None:
    """A drawn sample with how it was drawn: seed, size, allocation rule and what each stratum gave. Samples are
    what people label: a few hundred rows."""
    rows = [r.asDict(recursive=True) for r in sample.collect()]
    write_json(sample.sparkSession, {"seed": seed, "n": len(rows), "rule": rule, "strata": strata, "posts": rows}, path)
