"""Best-fit-decreasing packing of token pieces into sequences: a sweep over lengths on the driver.

Texts become ids and end in ``END``; only texts longer than a sequence are cut. Longest first, the
pieces of a length go to the least gap that holds them, or open new sequences. The method's dealt
rounds (range-sorted pieces and gaps, distributed successor sweeps, conflicts by rank) are not here: one
sequential loop on the driver replaces them, because its state is bounded by the length classes (at
most ``capacity``, 4096) however large the corpus, and needs no rounds of shuffles. Only tokenising,
the counts and the pieces' ranks are distributed.

Lengths are whole numbers up to the capacity, so all pieces of a length are one class and all
sequences filled alike are one run. The sweep over classes and runs needs only how many pieces each
length has (at most ``capacity`` numbers, however large the corpus). Its outcome is a short table of
stretches: pieces of rank r0 to r1 of a length go to consecutive sequences, so many to each, from
the same offset on. Every piece finds its stretch by its rank, which is counted distributedly in salted buckets,
so a length that a third of all pieces share is spread like any other. The result equals sequential
best-fit decreasing.

Nulls: a null text is empty: one piece with the end token; a null doc_id stays null, and ``row`` tells its
pieces apart. Repeated rows, and rows of one doc_id, are packed each, with a ``row`` of their own. Very long
texts are tokenised whole. Pieces of equal length are interchangeable; a seeded hash orders them. An empty
table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespar.llm._shared import bucket_bits, materialize, running, seeded_hash
from lodespar.llm._words import Words, bounded, slices, texts

CAPACITY, END = 4096, 1
#: Words whose ids a worker keeps, in each of two generations.
CACHE = 1 << 17
#: Words that are letters, then marks: two pre-tokens, each a word of the vocabulary's own spelling.
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_PLAIN = re.compile(r"([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]*)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> list[str]:
    """How byte-level vocabularies spell the 256 bytes: printable ones as themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


_SPELT = {b: letter for b, letter in enumerate(_byte_letters())}


class _Known(dict):
    """Ids of words as bytes; a word that is not there is looked up in the generation before, or made."""

    def __init__(self, make: Callable[[str], bytes], before: dict[str, bytes]):
        self.make, self.before = make, before

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.make(word)
        self[word] = ids
        return ids


def _ids_of(tokenizer, model, word: str) -> bytes:
    plain = _PLAIN.fullmatch(word)
    if plain:
        ids = []
        for part in plain.groups():
            if part:
                part = part.lower() if part.isascii() else part.lower().encode().decode("latin-1").translate(_SPELT)
                ids += [t.id for t in model.tokenize(part)]
    else:
        ids = tokenizer.encode(word, add_special_tokens=False).ids
    return array("I", ids).tobytes()


#: The steps of a tokenizer that works word by word: it lower-cases, drops white space, never joins across it, and
#: cuts between letters, digits and marks.
_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordTokens:
    """Ids of texts by any tokenizer.

    Words repeat far more often than texts do, so with a tokenizer that works word by word (``_BY_WORDS``, which the
    file is compared with) ids are looked up by word: a plain new word goes straight to the tokenizer's model, any
    other through all of the tokenizer. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Nothing that ``known`` holds refers back to it: it goes with its task, not with some later collection of cycles.
        self.make = partial(_ids_of, self.tokenizer, self.tokenizer.model)
        self.known = _Known(self.make, {})
        own = json.loads(self.tokenizer.to_str())
        self.by_words = all(own[k] == v for k, v in _BY_WORDS.items()) and all(t["content"].startswith("<|") for t in own["added_tokens"])

    @staticmethod
    def words(data: np.ndarray, offsets: np.ndarray) -> Words:
        """Words in lower case (of A to Z), marks at their ends as words of their own: the tokenizer
        lower-cases and cuts between a letter or digit and marks, so the ids are the same, and there
        are fewer distinct words. Not where a special token could stand or come about."""
        if b"<|" in data.tobytes():
            return Words(data, offsets)
        words = Words(data, offsets, lower=True)
        low, cut, live = words.data, words.end.copy(), np.ones(len(words.end), bool)
        for _ in range(3):
            live &= (cut - words.start > 1) & _MARK[low[np.maximum(cut - 1, 0)]]
            cut -= live
        last, before = low[cut - 1], low[np.maximum(cut - 2, words.start)]
        letter = _ALNUM[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
        tail = (cut < words.end) & letter
        at = np.cumsum(1 + tail) - (1 + tail)
        words.first = np.append(at, len(tail) + tail.sum())[words.first]
        start, end = (np.zeros(len(tail) + int(tail.sum()), np.int64) for _ in range(2))
        start[at], end[at] = words.start, np.where(tail, cut, words.end)
        start[at[tail] + 1], end[at[tail] + 1] = cut[tail], words.end[tail]
        words.start, words.end = start, end
        return words

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, each with ``END``, and where each begins (and the last ends)."""
        if not self.by_words:
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            found = [np.array([*e.ids, END], np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])
        if len(self.known) > CACHE:
            self.known = _Known(self.make, dict(self.known))
        words = self.words(data, offsets)
        raw = words.data.tobytes()
        # Each distinct word of the slice is looked up once.
        _, at, word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        found = [self.known[raw[a:b].decode("utf-8", "replace")] for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]
        every = np.frombuffer(b"".join(found), np.uint32)
        size = np.array([len(x) for x in found], np.int64) // 4
        begin, size = (np.cumsum(size) - size)[word], size[word]
        before = np.concatenate([[0], np.cumsum(size)])
        first = before[words.first] + np.arange(len(offsets))
        out = np.full(first[-1], END, np.uint32)
        inner = np.ones(len(out), bool)
        inner[first[1:] - 1] = False
        out[inner] = every[np.arange(before[-1]) + np.repeat(begin - before[:-1], size)]
        return out, first


def _pieces(path: str, capacity: int, with_ids: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(path)
        for batch in batches:
            for lo, hi, data, offsets in slices(texts(batch.column(1))):
                every, first = tokens.ids(data, offsets)
                owner, piece, start, length, crc, kept = [], [], [], [], [], []
                for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    for p, at in enumerate(range(a, b, capacity)):
                        part = every[at : min(at + capacity, b)]
                        owner.append(lo + k)
                        piece.append(p)
                        start.append(at - a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.astype("<u4", copy=False)))
                        if with_ids:
                            kept.append(part)
                cols = [batch.column(c).take(pa.array(owner, pa.int64())) for c in (0, 2)]
                cols += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(kept, pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return work


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, row (a number that the pieces of a row of ``docs`` share), piece, start, length, ids_crc32 and,
    if asked for, ids. To be written before it is used twice, which fixes the rows' numbers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(bounded(_pieces(tokenizer_path, capacity, with_ids)), "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset, pieces a sequence) of every stretch.

    Gaps are runs (gap, first sequence, sequences), sorted by gap; a run is the successor of a length
    if its gap is the least that holds it. A gap is filled before the next one of its run.
    """
    out, gaps, opened = [], [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, (length, -1, -1))
            if at < len(gaps):
                gap, first, n = gaps.pop(at)
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = min(gap // length, left)
            used = min(n, left // each)
            out.append((length, rank, used * each, first, capacity - gap, each))
            if used < n:
                insort(gaps, (gap, first + used, n - used))
            if gap > each * length:
                insort(gaps, (gap - each * length, first, used))
            rank, left = rank + used * each, left - used * each
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, seed: int = 17) -> DataFrame:
    """The pieces with sequence_id and offset. Only ids and lengths are sorted; other columns of the pieces
    (their token ids) meet their places in one join."""
    cut = materialize(cut, "pack-pieces")
    narrow = cut.select("doc_id", "row", "piece", "start", "length", "ids_crc32")
    counts = {r["length"]: r["n"] for r in narrow.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    spark = cut.sparkSession
    # From an Arrow table: rows of Python would start a daemon and workers of their own on every executor.
    names = ["length", "_r0", "_n", "_first", "_from", "_each"]
    columns = np.array(sweep(counts, capacity), np.int64).reshape(-1, len(names)).T
    stretches = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names))
    bits = bucket_bits(sum(counts.values()))
    hashed = narrow.withColumn("_h", seeded_hash(seed, F.col("doc_id"), F.col("row"), F.col("piece")))
    ranked = running(hashed.withColumn("_b", F.shiftright("_h", 60 - bits)), ["length"], "_b", [F.col("_h"), F.col("row"), F.col("piece")], "_rank")
    placed = ranked.join(materialize(stretches, "pack-stretches"), "length").where("_rank >= _r0 and _rank < _r0 + _n")
    at = F.col("_rank") - F.col("_r0")
    placed = placed.withColumn("sequence_id", F.col("_first") + F.expr("(_rank - _r0) div _each"))
    placed = placed.withColumn("offset", F.col("_from") + at % F.col("_each") * F.col("length"))
    if set(cut.columns) == set(narrow.columns):
        return placed.select(*cut.columns, "sequence_id", "offset")
    return cut.join(placed.select("row", "piece", "sequence_id", "offset"), ["row", "piece"]).select(*cut.columns, "sequence_id", "offset")
