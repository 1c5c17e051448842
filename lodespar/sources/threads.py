"""Raw threads: fetching into a landing folder, scanning, flattening, lookups.

Fetching pages from a web service is driver work by nature (a few requests a month); what it lands is
write-once JSON that every other function reads with Spark.
"""

from __future__ import annotations

import json
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodespar.functions.text import thread_date
from lodespar.functions.vocabulary import MONTHS
from lodespar.sources.logs import exists, write_text
from lodespar.sources.schemas import THREAD

TIMEOUT, RETRIES, PAGE, PAUSE = 30.0, 3, 100, 0.3
Get = Callable[[str, dict], dict]


def http_get(base: str, timeout: float = TIMEOUT, retries: int = RETRIES) -> Get:
    """A JSON client for one service: ``get(path, params)``."""

    def get(path: str, params: dict) -> dict:
        url = f"{base}{path}?{urllib.parse.urlencode(params)}"
        for attempt in range(retries + 1):
            try:
                with urllib.request.urlopen(url, timeout=timeout) as response:
                    return json.load(response)
            except OSError:
                if attempt == retries:
                    raise
        raise AssertionError

    return get


def hiring_threads(get: Get, author: str, limit: int) -> list[dict]:
    """The newest threads whose title asks who is hiring; other threads of the author are passed over."""
    hits = get("/search_by_date", {"tags": f"story,{author}", "hitsPerPage": limit * 3})["hits"]
    return [h for h in hits if re.search("who is hiring", h.get("title") or "", re.IGNORECASE)][:limit]


def top_level_comments(get: Get, thread_id: str, pause: float = PAUSE) -> list[dict]:
    found, page, pages = [], 0, 1
    while page < pages:
        body = get("/search", {"tags": f"comment,story_{thread_id}", "hitsPerPage": PAGE, "page": page})
        pages, page = body["nbPages"], page + 1
        found += [h for h in body["hits"] if str(h["parent_id"]) == str(thread_id)]
        time.sleep(pause)
    return found


def title_month(title: str | None) -> str | None:
    m = re.search(r"\(([A-Za-z]+)\s+(\d{4})\)", title or "")
    return f"{int(m[2]):04d}-{MONTHS.index(m[1].lower()) + 1:02d}-01" if m and m[1].lower() in MONTHS else None


def land(spark: SparkSession, get: Get, folder: str, thread_id: str, title: str | None = None, created: str | None = None, pause: float = PAUSE) -> int:
    """Write a thread once; how many comments were new (0 if the thread is there already)."""
    path = f"{folder}/{thread_id}.json"
    if exists(spark, path):
        return 0
    comments = top_level_comments(get, thread_id, pause)
    write_text(spark, path, json.dumps({"thread_id": str(thread_id), "title": title, "created_at": created, "thread_date": title_month(title), "comments": comments}))
    return len(comments)


def threads(spark: SparkSession, folder: str) -> DataFrame:
    """Every landed thread, oldest first (undated ones before all)."""
    df = spark.read.schema(THREAD).json(folder, multiLine=True, pathGlobFilter="*.json")
    if not df.inputFiles():
        raise FileNotFoundError(f"no threads in {folder}")
    return df.orderBy(F.coalesce("thread_date", F.lit("")))


def dated(df: DataFrame) -> DataFrame:
    """Threads with ``thread_date`` from their title where it is missing."""
    return df.withColumn("thread_date", F.coalesce("thread_date", thread_date(F.col("title")).cast("string")))


def hiring(df: DataFrame, limit: int | None = None) -> DataFrame:
    kept = df.where(F.col("title").rlike("(?i)who is hiring"))
    return kept.orderBy(F.desc("created_at"), "thread_id").limit(limit) if limit else kept


def latest(df: DataFrame) -> DataFrame:
    newest = df.agg(F.max(F.coalesce("thread_date", F.lit(""))).alias("_d"))
    return df.join(F.broadcast(newest), F.coalesce("thread_date", F.lit("")) == F.col("_d")).drop("_d")


def posts(df: DataFrame, date: str | None = None) -> DataFrame:
    """One row per comment, with its thread's date and its place in the thread."""
    flat = df.select("thread_id", "thread_date", F.posexplode("comments").alias("position", "c"))
    flat = flat.select("c.*", "thread_id", "thread_date", "position")
    return flat.where(F.col("thread_date") == date) if date else flat


def top_level(df: DataFrame, parent: str = "parent_id", thread: str = "thread_id") -> DataFrame:
    return df.where(F.col(parent).cast("string") == F.col(thread).cast("string"))


def example(df: DataFrame, wanted: int | str, key: str = "objectID", **expected) -> dict | None:
    """The one row of an id as a dict, if its columns are as expected; None if it is missing, repeated or differs."""
    rows = [r.asDict() for r in df.where(F.col(key) == F.lit(wanted)).limit(2).collect()]
    return rows[0] if len(rows) == 1 and all(rows[0].get(c) == v for c, v in expected.items()) else None


def first_posts(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("position") < n)


def by_id(df: DataFrame, ids: list, key: str = "objectID") -> DataFrame:
    """The rows of these ids in their order; any that is missing raises."""
    wanted = lookup(df, ids, key)
    missing = [r[key] for r in wanted.where("not found").select(key).collect()]  # ids of the request
    if missing:
        raise KeyError(f"not found: {', '.join(map(str, missing))}")
    return wanted.orderBy("position").drop("found")


def lookup(df: DataFrame, ids: list, key: str) -> DataFrame:
    """One row for each id asked for (``position``, ``found``); the last of rows with equal ids, in the order of the
    scan, wins."""
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), f"position int, {key} {df.schema[key].dataType.simpleString()}")
    placed = df.drop("position").withColumn("_at", F.monotonically_increasing_id())
    rows = placed.join(F.broadcast(wanted.select(key).distinct()), key, "left_semi")  # as many as the request names
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "_at")]), "_at")
    rows = rows.groupBy(key).agg(last.alias("_last")).select(key, "_last.*")
    return wanted.join(rows.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def latest_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    by = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")
