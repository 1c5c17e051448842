"""Connected components of a table of links, by alternating large and small stars.

Every step is a grouped minimum and an equi-join over the remaining links; nothing is collected. A
node with very many links meets its minimum in a partial aggregate and in a join that adaptive
execution can split. Each round is cut with a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespar.llm._shared import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v), u > v. Every node's larger (or smaller) neighbours are tied to its least one."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        tied = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u")
        tied = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node in ``links`` (two long columns)."""
    rows = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    rows, seen = materialize(rows, "cc"), None
    mark = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    while True:
        rows = materialize(_star(materialize(_star(rows, True), "cc"), False), "cc")
        now = tuple(rows.agg(*mark).first())
        if now == seen:
            break
        seen = now
    # Stars: every node but the least of each component has one link, to the least.
    return materialize(rows.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(rows.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "cc")
