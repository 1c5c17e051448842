"""Words of UTF-8 texts as numpy arrays, a slice of an Arrow batch at a time.

A word's hash is 64 bits; two words share one with a chance of about 2**-64. Texts are handled as
bytes, so any string, however long or odd, goes through unchanged.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text and texts handled at once (a longer single text makes a slice of its own).
SLICE, ROWS = 2 << 20, 4096
#: Arrays of as many bytes are given back to the system when they are freed, smaller ones once so many bytes are.
MAPPED, TRIMMED = 8 << 20, 64 << 20
#: Bytes of an Arrow batch.
BATCH, _BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = 64  # bytes; longer words are hashed one by one
U = np.uint64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)


def _libc(name: str, *args: int) -> None:
    function = getattr(ctypes.CDLL(None), name, None)
    if function is not None:
        function(*args)


def release() -> None:
    """Give freed memory back to the system: a worker is reused, and what it keeps counts against its
    executor while other stages run."""
    pa.default_memory_pool().release_unused()
    _libc("malloc_trim", 0)


def bounded(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over a task's batches, then ``release``.

    Called where a plan is made, it also lowers the session's bound on an Arrow batch to ``BATCH`` bytes:
    the batch is held by the JVM and by the worker, whatever the texts' length.
    """
    session = SparkSession.getActiveSession()
    if session is not None and int(session.conf.get(_BATCH_SETTING).rstrip("b")) > BATCH:
        session.conf.set(_BATCH_SETTING, str(BATCH))

    def run(batches: Iterator) -> Iterator:
        _libc("mallopt", -3, MAPPED)  # M_MMAP_THRESHOLD, which would grow with what is freed
        _libc("mallopt", -1, TRIMMED)  # M_TRIM_THRESHOLD, which would stay at 128 kB now
        try:
            yield from work(batches)
        finally:
            release()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def texts(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One binary array, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    return column.fill_null(b"") if column.null_count else column


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of at most ``ROWS`` rows with about ``limit`` bytes."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1), i + ROWS)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Words:
    """The words of some texts: byte ranges ``start``/``end``, and ``first`` word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, n = (_LOWER[data] if lower else data), len(data)
        solid = ~_SPACE[data]
        head, tail = solid.copy(), solid.copy()
        head[1:] &= ~solid[:-1]
        tail[:-1] &= ~solid[1:]
        for edge, at in ((head, offsets[:-1]), (tail, offsets[1:] - 1)):
            at = at[(offsets[1:] > offsets[:-1]) & (at < n)]
            edge[at] = solid[at]
        self.start, self.end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        length = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
        h = mix(length.astype(U) + U(0x9E3779B97F4A7C15))
        todo = np.flatnonzero(length <= _LONG)
        at, left, k = self.start[todo], length[todo], 0
        while len(todo):
            chunk = np.ascontiguousarray(eights[at]).view(U).ravel() & _MASK[np.minimum(left, 8)]
            h[todo] = mix((h[todo] ^ chunk) * U(0xD6E8FEB86659FD93))
            keep = left > 8
            todo, at, left, k = todo[keep], at[keep] + 8, left[keep] - 8, k + 1
        for i in np.flatnonzero(length > _LONG):
            word = self.data[self.start[i] : self.end[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every run of ``k`` words within a text: (hashes, first word of each,
    number per text)."""
    per = np.maximum(np.diff(first) - (k - 1), 0)
    ends = np.cumsum(per)
    at = np.arange(int(per.sum())) + np.repeat(first[:-1] - (ends - per), per)
    base = U(0x9E3779B97F4A7C15 | 1)
    if len(h) < k:
        return np.zeros(0, U), at, per
    roll = np.zeros(len(h) - k + 1, U)
    for j in range(k):
        roll = roll * base + h[j : len(h) - k + 1 + j]
    return mix(roll[at]), at, per


def by_text(counts: np.ndarray) -> np.ndarray:
    """The text of each element, from how many each text has."""
    return np.repeat(np.arange(len(counts)), counts)
