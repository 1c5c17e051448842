"""Elias-Fano sequences of numpy arrays in memory-mapped files.

A sorted sequence of n numbers below u keeps log2(u / n) low bits of each, packed, and the high bits in
unary in a bit vector of about 2n bits. A count of ones per word of that vector makes rank and select
a search over counts and six steps inside a word. All queries are vectorised over many at once.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np

U = np.uint64
_ONE = U(1)
#: Numbers encoded at once.
_BLOCK = 1 << 19


def _filesystem(uri: str):
    """None and the path for local files, else the Arrow file system and its path."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return None, parsed.path
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays. A task that is run again replaces the file whole."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    parts = [len(text).to_bytes(8, "little"), text]
    for a in arrays.values():
        parts += [np.ascontiguousarray(a).tobytes(), bytes(-a.nbytes % 8)]
    files, path = _filesystem(uri)
    new = f"{path}.{uuid.uuid4().hex}"
    if files is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(new, "wb") as f:
            f.writelines(parts)
        os.replace(new, path)
    else:
        with files.open_output_stream(new) as f:
            for p in parts:
                f.write(p)
        files.move(new, path)


_OPEN: dict[str, dict[str, np.ndarray]] = {}


def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped. Where the shared folder is no file system of the machine, the
    file is copied once to an unlinked temporary file, which goes with the worker."""
    if uri not in _OPEN:
        files, path = _filesystem(uri)
        if files is None:
            f = open(path, "rb")
        else:
            f = tempfile.TemporaryFile()
            with files.open_input_stream(path) as source:
                while block := source.read(1 << 24):
                    f.write(block)
            f.flush()
        with f:
            raw = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
        n = int(raw[:8].view(np.int64)[0])
        head = json.loads(raw[8 : 8 + n].tobytes())
        _OPEN[uri] = {k: raw[8 + n + at : 8 + n + at + np.dtype(kind).itemsize * size].view(kind) for k, (kind, at, size) in head.items()}
    return _OPEN[uri]


def close_arrays(*uris: str) -> None:
    """Forget mapped files that are not read again."""
    for uri in uris:
        _OPEN.pop(uri, None)


def _or_into(words: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """``words[at] |= bits`` for sorted ``at``."""
    if len(at):
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        words[at[first]] |= np.bitwise_or.reduceat(bits, first)


def encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Arrays of a sorted sequence of unsigned longs, named ``name`` and a suffix."""
    v, n = values.astype(U, copy=False), len(values)
    top = int(v[-1]) if n else 0
    low_bits = max(0, (max(1, top // max(n, 1))).bit_length() - 1)
    low = np.zeros(-(-n * low_bits // 64) + 1, U)
    high = np.zeros((n + (top >> low_bits) + 2) // 64 + 1, U)
    for at in range(0, n, _BLOCK):
        x = v[at : at + _BLOCK]
        i = np.arange(at, at + len(x), dtype=U)
        if low_bits:
            part, pos = x & U((1 << low_bits) - 1), i * U(low_bits)
            word, off = (pos >> U(6)).astype(np.int64), pos & U(63)
            _or_into(low, word, part << off)
            over = off + U(low_bits) > 64
            _or_into(low, word[over] + 1, part[over] >> (U(64) - off[over]))
        pos = (x >> U(low_bits)) + i
        _or_into(high, (pos >> U(6)).astype(np.int64), _ONE << (pos & U(63)))
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]])
    return {f"{name}.head": np.array([n, low_bits, top], U), f"{name}.low": low, f"{name}.high": high, f"{name}.ones": ones.astype(np.uint32 if n < 1 << 32 else np.int64)}


_BYTES = U(0x0101010101010101)
#: Position of the k-th set bit of a byte, flat: 8 for each byte.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[k] for byte in range(256) for k in range(8)], np.int64)


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the set bit of each word that has ``rank`` set bits below it.

    Counts of set bits up to each byte stand in the bytes of one word; those not above the rank are
    counted in parallel, which gives the byte; a table gives the bit.
    """
    rank = rank.astype(U)
    s = word - ((word >> _ONE) & U(0x5555555555555555))
    s = (s & U(0x3333333333333333)) + ((s >> U(2)) & U(0x3333333333333333))
    s = ((s + (s >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _BYTES
    passed = np.bitwise_count(((rank * _BYTES) | (_BYTES << U(7))) - s & (_BYTES << U(7))).astype(U) << U(3)
    below = ((s << U(8)) >> passed) & U(0xFF)
    byte = (word >> passed) & U(0xFF)
    return passed.astype(np.int64) + _IN_BYTE[((byte << U(3)) + (rank - below)).astype(np.int64)]


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        head, self.low, self.high, self.ones = (arrays[f"{name}.{x}"] for x in ("head", "low", "high", "ones"))
        self.n, self.low_bits, self.top = (int(x) for x in head)
        self._zeros = None

    def __len__(self) -> int:
        return self.n

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        pos = i.astype(U) * U(self.low_bits)
        word, off = (pos >> U(6)).astype(np.int64), pos & U(63)
        joined = (self.low[word] >> off) | np.where(off > 0, self.low[np.minimum(word + 1, len(self.low) - 1)] << ((U(64) - off) & U(63)), U(0))
        return joined & U((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, "right") - 1
        pos = word * 64 + _select(self.high[word], i - self.ones[word].astype(np.int64))
        return ((pos - i).astype(U) << U(self.low_bits)) | self._low(i)

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of the numbers whose high bits are ``h``."""
        if self._zeros is None:
            self._zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        h = h.astype(np.int64)
        k = np.maximum(h - 1, 0)
        word = np.searchsorted(self._zeros, k, "right") - 1
        pos = word * 64 + _select(~self.high[word], k - self._zeros[word])
        at = np.where(h == 0, 0, pos + 1)
        lo = at - h
        # Ones from here to the next zero; where the word ends first, the next zero is sought.
        word, off = at >> 6, at & 63
        rest = ~(self.high[np.minimum(word, len(self.high) - 1)] >> off.astype(U))
        run = np.bitwise_count((rest & (~rest + _ONE)) - _ONE).astype(np.int64)
        hi = lo + run
        over = np.flatnonzero(run >= 64 - off)
        if len(over):
            k = h[over]
            word = np.searchsorted(self._zeros, k, "right") - 1
            hi[over] = word * 64 + _select(~self.high[word], k - self._zeros[word]) - k
        return lo, hi

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each number (of a sequence without repeats), -1 where it is missing."""
        x = np.asarray(x, U)
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        todo = np.flatnonzero(x <= U(self.top))
        h = x[todo] >> U(self.low_bits)
        (lo, hi), want = self._bucket(h), x[todo] & U((1 << self.low_bits) - 1)
        while len(todo):
            live = lo < hi
            todo, lo, hi, want = todo[live], lo[live], hi[live], want[live]
            middle = (lo + hi) >> 1
            low = self._low(middle)
            hit = low == want
            out[todo[hit]] = middle[hit]
            lo, hi = np.where(low < want, middle + 1, lo), np.where(low > want, middle, hi)
            todo, lo, hi, want = todo[~hit], lo[~hit], hi[~hit], want[~hit]
        return out
