"""Removal of word windows that an earlier document has.

Every run of ``WINDOW`` words has a Rabin-Karp hash. A window is removed from a document if the same
window also starts in a document of smaller doc_id; windows that overlap or touch merge into maximal
intervals, and their words go.

The hashes are far too many to be rows of a shuffle. A task packs those of a run of documents into
one binary per hash range, sorted hashes as differences and the document of each. A hash that several
documents of the run share is sent for the first of them only, as the others are known to be repeats. A reducer counts one hash range (a bounded number of windows,
however common some are) and answers each document with the hashes it must remove, packed by buckets of
documents. Answers are as many as there are removed windows. Texts meet their answers in one join, as
zstd frames.

Windows are told apart by 64-bit hashes alone. Among 1.5e13 windows (100 TB) some six million pairs of unlike
ones share a hash, each a window removed by mistake; hashes twice as long would double what is shuffled. The
hashes are counted by sorting in the workers: as rows of Spark each would be 16 bytes of payload for a word of
six, with a row's overhead, more than the disk this operator may use.

Nulls: a null text has no words. Rows without doc_id are one document, the last; they are told apart by a hash
of their texts only to be spread over tasks. Rows of equal doc_id are one document: neither removes words of
the other; repeated rows lose the same words. Very long texts are hashed and cut whole. An empty table gives an
empty result. Other columns, whatever their names, are ignored by ``removal_digests`` and kept by
``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespar.llm._grouped import borders, over_runs
from lodespar.llm._shared import free_shuffles, materialize, own
from lodespar.llm._words import SLICE, U, Words, mix, slices, texts, windows, bounded

WINDOW = 13
#: Bytes of text for a hash range and for a bucket of answered documents, and windows that a task holds
#: before it sends them.
RANGE_BYTES, BUCKET_BYTES, HELD = 6 << 20, 8 << 20, 1 << 20
#: Documents without id have keys from here on; real ids are below.
NO_ID, SPREAD = (1 << 63) - (1 << 21), 1 << 20
_CODEC = pa.Codec("zstd", compression_level=3)


def _pack(h: np.ndarray, doc: np.ndarray) -> bytes:
    """Sorted hashes as differences of fewest bytes, and the document of each by its place in a list."""
    ids, place = np.unique(doc, return_inverse=True)
    steps = np.diff(h, prepend=h[:1])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    small = np.uint16 if len(ids) < 1 << 16 else np.uint32
    head = np.array([len(ids), len(h), width, int(h[0])], U)
    return head.tobytes() + ids.tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + place.astype(small).tobytes()


def _unpack(blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    m, n, width, first = (int(x) for x in np.frombuffer(blob, U, 4))
    ids = np.frombuffer(blob, np.int64, m, 32)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, 32 + 8 * m).reshape(n, width)
    place = np.frombuffer(blob, np.uint16 if m < 1 << 16 else np.uint32, n, 32 + 8 * m + n * width)
    return U(first) + np.cumsum(wide.view("<u8").ravel(), dtype=U), ids[place]


def _ask(ranges: int, buckets: int, window: int):
    """Rows (part, bucket, blob): packed windows of a hash range, or (with a bucket) answers that a task
    knows by itself."""

    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, doc = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        held.clear()
        # By hash, then document: the first of each hash is asked about, the others are repeats. Documents without
        # id are no repeats of each other; all of them are asked about if they are the first.
        order = np.argsort(h)
        h, doc = h[order], doc[order]
        same = h[1:] == h[:-1]
        several = np.zeros(len(h), bool)
        several[1:] |= same
        several[:-1] |= same
        some = np.flatnonzero(several)
        doc[some] = doc[some][np.lexsort((doc[some], h[some]))]
        first = np.append(True, ~same)
        new = np.append(True, ~same | (doc[1:] != doc[:-1]))
        rank = np.minimum(doc, NO_ID)
        starts = np.flatnonzero(first)
        repeat = rank > np.repeat(rank[starts], np.diff(np.append(starts, len(h))))
        late, first = np.flatnonzero(new & repeat), new & ~repeat
        if len(late):
            yield _answers(h[late], doc[late], buckets, int(h[late[0]] >> U(32)) % ranges)
        h, doc = h[first], doc[first]
        part = (((h >> U(32)) * U(ranges)) >> U(32)).astype(np.int64)
        cut = borders(part)
        blobs = [_pack(h[lo:hi], doc[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), pa.nulls(len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["part", "bucket", "blob"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, data, offsets in slices(texts(batch.column(1))):
                words = Words(data, offsets)
                h, _, per = windows(words.hashes(), words.first, window)
                if len(h):
                    held.append((h, np.repeat(ids[i:j], per)))
                    n += len(h)
                if n >= HELD:
                    yield from send(held)
                    n = 0
        if held:
            yield from send(held)

    return work


def _answers(h: np.ndarray, doc: np.ndarray, buckets: int, part: int = 0) -> pa.RecordBatch:
    """Rows (part, bucket of documents, blob) of the hashes that each document must remove."""
    bucket = (mix(doc.view(U)) % U(buckets)).astype(np.int64)
    order = np.lexsort((doc, bucket))
    h, doc, bucket = h[order], doc[order], bucket[order]
    cut = borders(bucket)
    blobs = []
    for lo, hi in zip(cut[:-1], cut[1:]):
        ids, counts = np.unique(doc[lo:hi], return_counts=True)
        blobs.append(np.int64(len(ids)).tobytes() + ids.tobytes() + counts.astype(np.int32).tobytes() + h[lo:hi].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), part, np.int64)), pa.array(bucket[cut[:-1]]), pa.array(blobs, pa.binary())], ["part", "bucket", "blob"])


def _gather(table: pa.Table) -> pa.RecordBatch:
    """Whole buckets: one row per document with all its hashes."""
    hashes, docs = [], []
    for b in table["blob"]:
        raw = b.as_buffer()
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        docs.append(np.repeat(np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int32, n, 8 + 8 * n)))
        hashes.append(np.frombuffer(raw, U, -1, 8 + 12 * n))
    h, doc = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    cut = borders(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc[cut[:-1]]), pa.array([h[lo:hi].tobytes() for lo, hi in zip(cut[:-1], cut[1:])], pa.binary())], ["doc", "gone"])


def _count(buckets: int):
    def work(table: pa.Table) -> pa.RecordBatch:
        """Whole hash ranges: documents whose windows an earlier document has."""
        known = table.filter(table["bucket"].is_valid())
        blobs = table["blob"].filter(table["bucket"].is_null())
        if not len(blobs):
            return known.combine_chunks().to_batches()[0]
        h, doc = (np.concatenate(x) for x in zip(*(_unpack(b.as_buffer()) for b in blobs)))
        order = np.argsort(h)
        h, doc = h[order], doc[order]
        starts = borders(h)[:-1]
        least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(h))))
        late = np.minimum(doc, NO_ID) > np.minimum(least, NO_ID)
        found = _answers(h[late], doc[late], buckets)
        return pa.Table.from_batches([*known.to_batches(), found]).combine_chunks().to_batches()[0] if len(known) else found

    return work


def _covered(at: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Words in the union of the windows that start at ``at``."""
    change = np.zeros(n_words + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return np.cumsum(change[:-1]) > 0


def _remove(window: int, digest: bool):
    """Texts without the words of the windows asked for, as kept texts or their digests."""

    def some(rows: list[bytes | None], asked: list[bytes | None], rest: list[pa.Array], names: list[str]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(r or b"") for r in rows])])
        raw = b"".join([r or b"" for r in rows])
        words = Words(np.frombuffer(raw, np.uint8), offsets)
        removed, kept = np.zeros(len(rows), np.int64), []
        h, at, per = windows(words.hashes(), words.first, window) if any(asked) else (None, None, np.zeros(len(rows), np.int64))
        ends = np.cumsum(per)
        for k, own in enumerate(asked):
            lo, hi = words.first[k], words.first[k + 1]
            keep = slice(lo, hi)
            if own:
                mine, here = np.frombuffer(own, U), slice(ends[k] - per[k], ends[k])
                found = mine[np.minimum(np.searchsorted(mine, h[here]), len(mine) - 1)] == h[here]
                out = _covered(at[here][found] - lo, hi - lo, window)
                removed[k], keep = out.sum(), lo + np.flatnonzero(~out)
            if digest or removed[k]:
                text = b" ".join([raw[a:b] for a, b in zip(words.start[keep].tolist(), words.end[keep].tolist())])
                kept.append(hashlib.sha256(text).hexdigest() if digest else text)
            else:
                kept.append(rows[k])
        return pa.RecordBatch.from_arrays([*rest, pa.array(words.counts.astype(np.int64)), pa.array(removed), pa.array(kept, pa.string() if digest else pa.binary())], [*names, "n_words", "n_removed", "kept"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c not in ("text", "gone")]
            first, held, rows = 0, 0, []
            for k, text in enumerate(batch.column("text")):
                rows.append(_whole(text))
                held += len(rows[-1] or b"")
                if held >= SLICE or k + 1 == batch.num_rows:
                    yield some(rows, batch.column("gone").slice(first, len(rows)).to_pylist(), [batch.column(c).slice(first, len(rows)) for c in names], names)
                    first, held, rows = k + 1, 0, []

    return work


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(F.col("text").cast("binary")), F.lit(SPREAD)))


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, gone): for each document with windows to remove, their hashes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, buckets = max(1, -(-size // RANGE_BYTES)), max(1, -(-size // BUCKET_BYTES))
    rows = docs.select(_key().alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "part long, bucket long, blob binary"
    answers = over_runs(rows.mapInArrow(bounded(_ask(ranges, buckets, window)), schema), "part", [], _count(buckets), schema)
    return over_runs(answers, "bucket", [], _gather, "doc long, gone binary")


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd frames behind their length, for the shuffle; null stays null."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        small = [None if not t.is_valid else len(t.as_py()).to_bytes(8, "little") + _CODEC.compress(t.as_buffer(), asbytes=True) for t in batch.column(at)]
        yield batch.set_column(at, "text", pa.array(small, pa.binary()))


def _whole(text: pa.Scalar) -> bytes | None:
    raw = text.as_py()
    return None if raw is None else _CODEC.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def _joined(docs: DataFrame, columns: list[str], window: int) -> DataFrame:
    """The columns, binary ``text`` squeezed, and ``gone`` of each row."""
    gone = materialize(repeated(docs, window), "sub-gone")
    free_shuffles(docs.sparkSession)
    rows = docs.select(*columns, F.col("text").cast("binary").alias("text"), _key().alias("_key"))
    return rows.mapInArrow(bounded(_squeeze), rows.schema).join(gone.withColumnRenamed("doc", "_key"), "_key", "left").drop("_key")


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the kept words joined by a space."""
    rows = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], window)
    return rows.mapInArrow(bounded(_remove(window, True)), "doc_id long, n_words long, n_removed long, kept string").withColumnRenamed("kept", "kept_sha256")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``; texts that lose words become their kept words joined by a space, other
    texts stay as they are. Rows that lose all their words go."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    rows = _joined(docs.select("text", "doc_id", *[c.alias(n) for c, n in zip(own(docs, "text"), names.values())]), list(names.values()), window)
    kinds = "".join(f"{names[f.name]} {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    out = rows.mapInArrow(bounded(_remove(window, False)), f"{kinds}n_words long, n_removed long, kept binary").where("n_removed = 0 or n_removed < n_words")
    return out.select(*[(F.col("kept").cast("string") if c == "text" else F.col(names[c])).alias(c) for c in docs.columns])
