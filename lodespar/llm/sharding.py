"""Proportional stratified interleaving.

Rows are ranked in a seeded shuffle within their source; a row's place is its fractional rank
``(rank + 0.5) / rows of the source``; the rows sorted by place are cut into equal runs, so that
every run holds each source in its share of the whole, to within a row or so.

Both orders (within a source, and over all rows) are numbered bucket by bucket: the buckets are
leading bits of the shuffle hash and of the place, about 512 rows each, and only one row per bucket
is summed up centrally. A source with a third of all rows is therefore spread over as many tasks as
its share asks for. The text is read once and never shuffled.

Nulls: a null source is a source of its own, a null id is shuffled by its text, a null text has no bytes.
Repeated rows are kept and numbered like any other; they are interchangeable. Groups of equal texts are
not kept together: under the law of equal row counts each copy is dealt by its own hash, and ``text_crc32``
tells which rows they are. Very long texts count as one row. An empty table gives an empty result. Other
columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespar.llm._shared import bucket_bits, materialize, row_hash, running, source_key


def interleave(docs: DataFrame, n_shards: int, seed: int = 17) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot: row counts of shards are at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            source_key().alias("_k"),
            F.octet_length(text).cast("long").alias("_bytes"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            row_hash(seed).alias("_h"),
        ),
        "shard-rows",
    )
    totals = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_of"))
    n = rows.count()
    bits = bucket_bits(n)
    order = [F.col("_h"), F.col("doc_id"), F.col("text_crc32"), F.col("_bytes")]
    ranked = running(rows.withColumn("_b", F.shiftright("_h", 60 - bits)), ["_k"], "_b", order, "_rank")
    placed = ranked.join(materialize(totals, "shard-totals"), "_k").withColumn("_place", (F.col("_rank") + F.lit(0.5)) / F.col("_of"))
    placed = materialize(placed.withColumn("_b", F.floor(F.col("_place") * (1 << bits))), "shard-places")
    placed = running(placed.withColumn("_all", F.lit(0)), ["_all"], "_b", [F.col("_place"), F.col("_k"), F.col("_rank")], "_at")
    shard = F.expr(f"(_at * {n_shards}) div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id",
        F.when(F.col("_k") != "1", F.substring("_k", 2, 1 << 30)).alias("source"),
        (F.col("_bytes") + 16).alias("size"),
        "text_crc32",
        F.col("shard").cast("int").alias("shard"),
        (F.col("_at") - first).cast("long").alias("slot"),
    )
