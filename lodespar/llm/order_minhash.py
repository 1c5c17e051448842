"""Order MinHash fingerprints, entirely in DataFrame functions.

The k-mers of a text are its runs of ``KMER`` words, each numbered by how often it has occurred
before, so that repeats count. A fingerprint has ``BINS`` samples. In round after round each numbered k-mer
is hashed anew; the hash's leading bits deal it to a sample. A sample keeps the ``PICK`` least hashes of
its earliest rounds. Those are put back into the order in which they stand in the text, and the tuple is
hashed. Two texts agree in a sample only if they share the same least k-mers in the same order, which is
what makes the likeness follow edit distance rather than mere overlap.

There are as many rounds as give ``DEALT`` hashes: one for texts of that many k-mers, more for short ones
(``ROUNDS`` at most), so that their samples hold tuples too and not single k-mers. As a sample only falls
back on a later round for what earlier ones lack, texts of different lengths stay comparable.

All per-text work is array functions over packed 64-bit keys (sample, round, hash, position), so sorting is
a sort of primitive longs and nothing is exploded: fingerprints are a narrow projection of the scan. A
position has 28 bits; Spark's arrays cannot hold a text of more words.

Nulls: a null text is the empty text, a null doc_id comes after all others. A text of fewer words than
``KMER`` is one k-mer; one without words has an empty fingerprint, alike (1.0) only to another empty one.
Rows of equal doc_id follow one another by a hash of their texts; rows that are equal in both are
interchangeable, and each has another of them as its next. Long texts are fingerprinted whole. An empty table
gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespar.llm._shared import WORD, let

KMER, PICK, BIN_BITS = 3, 2, 6
BINS = 1 << BIN_BITS
#: Hashes that are dealt to the samples of a short text, and rounds at most.
DEALT, ROUND_BITS = 6 * BINS, 5
ROUNDS = 1 << ROUND_BITS
#: Low bits of a packed key hold the k-mer's position.
POSITION_BITS = 28
_LOW = (1 << POSITION_BITS) - 1


def _lower_bound(array: Column, size: Column, value: Column) -> Column:
    """Index (from 0) of the first element of the sorted array that is not below ``value``."""
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(size + 1)), F.lit(0)).cast("int") + 1)
    start = F.struct(F.lit(0).alias("lo"), size.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(array, mid) < value
        return F.when(s["lo"] >= s["hi"], s).when(below, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    return F.aggregate(steps, start, halve)["lo"]


def _pack(hashed: Column, position: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~_LOW)).bitwiseOR(position.bitwiseAND(F.lit(_LOW)))


def _kmers(words: Column) -> Column:
    """Sorted packed keys of the k-mers of an array of words."""
    one = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(KMER)])
    many = F.transform(F.sequence(F.lit(0), F.size(words) - KMER), lambda i: _pack(one(i), i.cast("long")))
    few = F.array(_pack(F.xxhash64(words), F.lit(0).cast("long")))
    none = F.array().cast("array<bigint>")
    return F.sort_array(F.when(F.size(words) >= KMER, many).when(F.size(words) > 0, few).otherwise(none))


def _dealt(keys: Column) -> Column:
    """From sorted keys of k-mers, sorted keys (sample, round, hash, position) of numbered k-mers."""
    kmer = lambda x: F.shiftright(x, POSITION_BITS)

    def number(x: Column, i: Column) -> Column:
        again = (i > 0) & (kmer(F.get(keys, i - 1)) == kmer(x))
        first = _lower_bound(keys, F.size(keys), F.shiftleft(kmer(x), POSITION_BITS))
        return F.when(again, i - first).otherwise(F.lit(0))

    def deal(x: Column, occurrence: Column, r: Column) -> Column:
        h = F.xxhash64(kmer(x), occurrence, r)
        rest = F.shiftrightunsigned(F.shiftleft(h, BIN_BITS), BIN_BITS + ROUND_BITS)
        ordered = F.shiftleft(F.shiftrightunsigned(h, 64 - BIN_BITS), 64 - BIN_BITS).bitwiseOR(F.shiftleft(r.cast("long"), 64 - BIN_BITS - ROUND_BITS)).bitwiseOR(rest)
        return _pack(ordered, x)

    rounds = F.least(F.lit(ROUNDS), F.ceil(F.lit(DEALT) / F.size(keys))).cast("int")
    one = F.transform(keys, lambda x, i: deal(x, number(x, i), F.lit(0)))
    many = F.flatten(F.transform(keys, lambda x, i: let(number(x, i), lambda n: F.transform(F.sequence(F.lit(0), rounds - 1), lambda r: deal(x, n, r)))))
    return F.sort_array(F.when(F.size(keys) >= DEALT, one).when(F.size(keys) > 0, many).otherwise(F.array().cast("array<bigint>")))


def _tuples(keys: Column) -> Column:
    """An int for each sample that is not empty: its number and 26 bits of its tuple's hash."""
    sample = lambda x: F.shiftrightunsigned(x, 64 - BIN_BITS)
    starts = F.filter(F.when(F.size(keys) > 0, F.sequence(F.lit(0), F.size(keys) - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (sample(F.get(keys, i)) != sample(F.get(keys, i - 1))))

    def one(i: Column) -> Column:
        mine = F.filter(F.slice(keys, i + 1, F.lit(PICK)), lambda x: sample(x) == sample(F.get(keys, i)))
        in_text_order = F.sort_array(F.transform(mine, lambda x: F.shiftleft(x, 64 - POSITION_BITS).bitwiseXOR(F.lit(-(1 << 63))).bitwiseOR(F.shiftrightunsigned(x, POSITION_BITS))))
        tuple_hash = F.xxhash64(F.transform(in_text_order, lambda y: y.bitwiseAND(F.lit((1 << (64 - POSITION_BITS)) - 1))))
        return F.shiftleft(sample(F.get(keys, i)), 26).bitwiseOR(tuple_hash.bitwiseAND(F.lit((1 << 26) - 1))).cast("long").bitwiseXOR(F.lit(1 << 31)) - F.lit(1 << 31)

    return F.transform(starts, lambda i: one(i).cast("int"))


def fingerprint(text: Column) -> Column:
    """array<int>, sparse by sample, in the order of samples."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)
    return let(words, lambda w: let(_kmers(w), lambda k: let(_dealt(k), _tuples)))


def as_string(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Samples that agree, of those that either text has."""
    samples = lambda fp: F.transform(fp, lambda x: F.shiftrightunsigned(x, 26))
    either = F.size(F.array_union(samples(a), samples(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _ranges(rows: DataFrame) -> list[tuple[int, int]]:
    """Greatest keys (at, tie) of ranges of about equal depth, half the root of the number of rows. An ``at`` of
    more rows than a range is cut by ``tie``."""
    n, last = rows.agg(F.count(F.lit(1)), F.max(F.struct("_at", "_tie"))).first()
    if not n:
        return [(0, 0)]
    k = math.ceil(math.sqrt(n) / 2)
    cuts = [i / k for i in range(1, k)] or [1.0]
    ids = sorted({*rows.agg(F.percentile_approx("_at", cuts, max(10_000, 20 * k)).alias("b")).first()["b"], last["_at"]})
    table = F.from_json(F.lit(json.dumps(ids)), "array<bigint>")
    known = rows.where(F.get(table, _lower_bound(table, F.lit(len(ids)), F.col("_at"))) == F.col("_at"))
    found = known.groupBy("_at").agg(F.max("_tie").alias("tie"), F.count(F.lit(1)).alias("n")).collect()  # at most a row a range
    hot = {r["_at"]: math.ceil(r["n"] * k / n) for r in found if r["n"] * k > 2 * n}
    bounds = {(r["_at"], r["tie"]) for r in found}
    if hot:
        parts = F.element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col("_at"))
        cell = F.floor((F.shiftright("_tie", 32) + (1 << 31)) * parts / (1 << 32))
        bounds |= {(r["_at"], r["tie"]) for r in known.where(F.col("_at").isin(list(hot))).groupBy("_at", cell).agg(F.max("_tie").alias("tie")).collect()}  # likewise
    return sorted(bounds)


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row with ``next_<column>`` of the row after it in descending order of ``key`` (null last), and of the
    first row after the last. Equal keys are ordered by a hash of the first of the columns.

    The rows are dealt to ranges of key and hash, whose bounds are those of rows of the table; the row that
    opens a range is also sent, as a ghost, to the end of the range before it. Each row moves once, and a
    range is one window group, which spills.
    """
    rows = docs.withColumns({"_at": F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), "_tie": F.xxhash64(columns[0])})
    bounds = _ranges(rows.select("_at", "_tie"))
    table = F.from_json(F.lit(json.dumps([{"a": a, "t": t} for a, t in bounds])), "array<struct<a:bigint,t:bigint>>")
    last, own = len(bounds) - 1, F.struct(F.col("_at").alias("a"), F.col("_tie").alias("t"))
    rows = rows.withColumn("_bucket", _lower_bound(table, F.lit(last + 1), own))
    opens = F.get(table, F.col("_bucket")) == own
    here = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("ghost"))
    before = F.struct(F.when(F.col("_bucket") == last, F.lit(0)).otherwise(F.col("_bucket") + 1).alias("b"), F.lit(1).alias("ghost"))
    rows = rows.withColumn("_to", F.explode(F.when(opens, F.array(here, before)).otherwise(F.array(here)))).withColumns({"_bucket": F.col("_to.b"), "_ghost": F.col("_to.ghost")})
    by = Window.partitionBy("_bucket").orderBy("_ghost", F.desc("_at"), F.desc("_tie"))
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(by) for c in columns})
    return rows.where("_ghost = 0").drop("_at", "_tie", "_bucket", "_to", "_ghost")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by as many of the first of the following text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("fp", fingerprint(F.col("text")))
    rows = with_next(rows, "doc_id", ["text", "fp"])
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text"))).drop("next_text")
    rows = rows.withColumn("edited_fp", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("fp")).alias("fingerprint"),
        as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
