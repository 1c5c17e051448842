"""Mixing sources to target weights by a low-discrepancy schedule of equal-word blocks.

Slot ``n`` of the schedule falls at the point frac(n * golden ratio) of the unit interval, which is
cut into one piece per source, as long as the source's share of the target. The slots of a source
are ranked; its documents, in a seeded shuffle, form one line of words, repeated epoch after epoch,
and slot ``k`` of the source takes the ``k``-th block of ``block_words`` words of that line. A source
whose slots are too many ends at its target; the few that the low-discrepancy sequence leaves short
(a logarithm of the number of slots) get the rest of their blocks at the schedule's end. Every
source thus takes exactly its target, rounded to a word.

At scale: texts are read once for their sizes and never shuffled. Slot ranks and the line of words
are running sums over buckets (``_shared.running``), so a source with a third of all rows is dealt
over many tasks. The point-to-source lookup is an equi-join on 4096 cells of the unit interval. The
per-source table has a row per source and is written as a table, so Catalyst broadcasts it only if
it is small.

Nulls and ties: a null source is a source of its own (last); a null or blank text has size 0, is in
no block and takes 0; a null doc_id is shuffled by its text. Repeated rows are separate documents, and
rows that are equal in id and text interchangeable. A very long text lies in as many blocks as it fills.
No rows, or no words at all, give targets of 0. Columns beyond doc_id, text and source, whatever their
names, are ignored by ``mix`` and kept by ``mix_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespar.llm._shared import WORD, bucket_bits, materialize, own, row_hash, running, source_key

#: frac(n * GOLDEN / 2**32) is the golden-ratio sequence (its mirror image), in exact integers.
GOLDEN, TURN, CELLS = 1640531527, 1 << 32, 4096
#: Words of a block.
BLOCK = 2048
#: Copies of a row that one task writes after another.
RUN = 1000


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, _k (source key), size in words, _h (the shuffle), _t (the text's hash)."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return materialize(docs.select("doc_id", source_key().alias("_k"), size.alias("size"), row_hash(seed).alias("_h"), _text_hash().alias("_t")), "mix-sizes")


def targets(rows: DataFrame, weights: list[int], most: int) -> DataFrame:
    """_k, source_size, target, quota (rounded), _lo, _hi (its piece of the unit interval).

    Sources below their weight's share are saturated at ``most`` times their size, in ascending
    order of that cap per weight; the level of the others is the largest level seen on the way.
    """
    per = rows.groupBy("_k").agg(F.sum("size").alias("source_size"))
    by_key, total = Window.orderBy("_k"), Window.partitionBy()
    per = per.withColumn("_i", F.row_number().over(by_key) - 1).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("_cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_k").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(total) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    level = left.cast("double") / (F.sum("_w").over(total) - F.coalesce(F.sum("_w").over(before), F.lit(0))).cast("double")
    per = per.withColumn("_level", level).withColumn("_level", F.max("_level").over(total))
    per = per.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")))
    share = F.coalesce(F.try_divide(F.sum("target").over(by_key.rowsBetween(Window.unboundedPreceding, 0)), F.sum("target").over(total)), F.lit(0.0))
    per = per.withColumn("_hi", share).withColumn("_lo", F.coalesce(F.lag("_hi").over(by_key), F.lit(0.0)))
    return materialize(per.select("_k", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("quota"), "_lo", "_hi"), "mix-targets")


def schedule(sources: DataFrame, n_slots: int, block_words: int) -> DataFrame:
    """slot, _k, rank: which block (by rank) of which source each slot takes."""
    cell = lambda c: F.least(F.floor(F.col(c) * CELLS), F.lit(CELLS - 1)).cast("long")
    cells = materialize(sources.where("_hi > _lo").withColumn("_cell", F.explode(F.sequence(cell("_lo"), cell("_hi")))).select("_cell", "_k", "_lo", "_hi"), "mix-cells")
    point = ((F.col("id") % TURN) * GOLDEN) % TURN / F.lit(float(TURN))
    slots = sources.sparkSession.range(n_slots).withColumn("_p", point).withColumn("_cell", F.floor(F.col("_p") * CELLS).cast("long"))
    slots = slots.join(cells, "_cell").where("_p >= _lo and _p < _hi").select(F.col("id").alias("slot"), "_k", F.expr("id div 8192").alias("_b"))
    needed = sources.select("_k", F.expr(f"(quota + {block_words - 1}) div {block_words}").alias("_need"))
    ranked = materialize(running(slots, ["_k"], "_b", [F.col("slot")], "rank"), "mix-slots")
    made = ranked.groupBy("_k").agg(F.count(F.lit(1)).alias("_made"))
    rest = needed.join(made, "_k", "left").withColumn("_made", F.coalesce("_made", F.lit(0))).where("_need > _made")
    rest = rest.withColumn("rank", F.explode(F.expr("sequence(_made, _need - 1)"))).select((F.col("rank") + n_slots).alias("slot"), "_k", "rank")
    return ranked.join(needed, "_k").where("rank < _need").select("slot", "_k", "rank").unionByName(rest)


def mix(docs: DataFrame, weights: list[int], most: int = 3, block_words: int = BLOCK, seed: int = 17) -> DataFrame:
    """The mixture, a row for each stretch of a document in a slot.

    slot, epoch, doc_id, source key ``_k``, text hash ``_t`` and ``_rank`` (which row of the input), size,
    source_size, target, first_word, n_words. A document that is in no slot has one row without
    slot, with n_words 0.
    """
    rows = sized(docs, seed)
    n, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    sources = targets(rows, weights, most)
    slots = schedule(sources, math.ceil(words / block_words), block_words)
    bits = bucket_bits(n)
    line = running(rows.withColumn("_b", F.shiftright("_h", 60 - bits)), ["_k"], "_b", [F.col("_h"), F.col("doc_id"), F.col("_t")], "_rank", "size", "_start")
    line = line.drop("_b").join(sources.drop("_lo", "_hi"), "_k")
    # A document's copies: one for each epoch in which the target reaches it.
    epochs = F.expr(f"filter(transform(sequence(0, {most - 1}), e -> named_struct('e', e, 'a', e * source_size + _start)), x -> x.a < quota and size > 0)")
    copies = line.withColumn("_c", F.explode_outer(epochs)).withColumns({"epoch": F.col("_c.e"), "_a": F.col("_c.a")}).withColumn("_z", F.expr("least(_a + size, quota)"))
    blocks = copies.withColumn("rank", F.explode_outer(F.expr(f"sequence(_a div {block_words}, (_z - 1) div {block_words})")))
    parts = blocks.join(slots, ["_k", "rank"], "left")
    low, high = F.greatest("_a", F.col("rank") * block_words), F.least("_z", (F.col("rank") + 1) * block_words)
    return parts.select("slot", "epoch", "doc_id", "_k", "_t", "_rank", "size", "source_size", "target", (low - F.col("_a")).alias("first_word"), F.coalesce(F.when(F.col("slot").isNotNull(), high - low), F.lit(0)).alias("n_words"))


def taken(parts: DataFrame) -> DataFrame:
    """Per document of ``mix``: doc_id, size, source_size, target, taken, and which slots of the schedule took
    it: first_slot (null: none) and n_slots."""
    of = parts.groupBy("_k", "_rank", "doc_id", "size", "source_size", "target").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots"))
    return of.drop("_k", "_rank")


def mix_documents(docs: DataFrame, weights: list[int], most: int = 3, block_words: int = BLOCK, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes at least half of its words.

    Documents without words weigh nothing in a mixture of words and are kept once. Of rows equal in id and
    text, one stands for all: it is written as often as the mixture takes them together.
    """
    parts = mix(docs, weights, most, block_words, seed)
    copies = parts.groupBy("_k", "_rank", "doc_id", "_t", "epoch", "size").agg(F.sum("n_words").alias("_words")).withColumn("_one", F.when((F.col("size") == 0) | (F.col("_words") * 2 >= F.col("size")), 1).otherwise(0))
    copies = copies.groupBy(source_key("doc_id").alias("_d"), "_t").agg(F.sum("_one").alias("_copies"), F.count_distinct("_k", "_rank").alias("_m"))
    copies = materialize(copies.where("_copies > 0"), "mix-copies")
    keyed = docs.select(F.struct(*own(docs)).alias("_all"), source_key("doc_id").alias("_d"), _text_hash().alias("_t"))
    one = keyed.join(copies.where("_m = 1").drop("_m"), ["_d", "_t"]).withColumn("_copy", F.explode(F.expr("sequence(1, _copies)"))).select("_all.*")
    again = copies.where("_m > 1").drop("_m")
    if not again.limit(1).count():
        return one
    # Many equal rows may be written many times: in runs of a bounded length, dealt anew.
    several = keyed.join(again, ["_d", "_t"]).groupBy("_d", "_t", "_copies").agg(F.min_by("_all", F.xxhash64(F.to_json("_all"))).alias("_all"))
    several = several.withColumn("_run", F.explode(F.expr(f"sequence(0, (_copies - 1) div {RUN})"))).repartition("_d", "_t", "_run")
    several = several.withColumn("_copy", F.explode(F.expr(f"sequence(1, least({RUN}, _copies - _run * {RUN}))")))
    return one.unionByName(several.select("_all.*"))
