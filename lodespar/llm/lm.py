"""Language-model scoring by an Elias-Fano n-gram trie.

Order 3. Words are numbered by the order of their 64-bit hashes. The trie's levels are cut into a few
files in the shared folder, which workers map into memory:

- words: hash ranges, the sorted hashes of a range as an Elias-Fano sequence, with their counts;
- pairs and triples: ranges of the pair (u, v), a file of each for a range. One has its first words u,
  monotone pointers to their pairs, and the second words (each range continuing after the last, so that all
  are one monotone sequence); the other pointers from those pairs to their third words, and these. Beside each
  pair and triple stands its quantised discounted probability, beside each context the quantised weight it
  leaves to the shorter context.

A query narrows to the context's range by the pointers, then looks its word up relative to it. Queries
are made many at once, sorted, one file after the other.

    p(w | u v) = a(u v w) + b(u v) * (a(v w) + b(v) * p(w)),   a = (c - D) / c(context),
    b(context) = 1 - sum of its a,   p(w) = (c + 1) / (N + V + 1)

Pairs and triples of fewer than ``least`` occurrences are not kept; their mass goes to b. The query op6 keeps
all (``least=1``), ``LEAST_COUNT`` is what callers get who do not say. Either way p sums to one over the known
words and one unknown word. The end of a text is a token.

Counting: the tokens of a pass over the training texts are counted in a worker by runs of texts and
sent as packed blobs, one for each shard: sorted keys as differences of fewest bytes, and the counts
above one. A reducer merges the blobs of a shard and leaves the counts that are kept; then ``GROUP`` shards at
a time become one file of the trie. Shards hold about as many tokens each, whatever the words: their
bounds are quantiles of a sample of pairs, drawn by hash in proportion to the number of shards and sorted in
Spark; the driver receives a bound a shard. Texts are passed over four times (words, pairs, triples, scores)
and never shuffled. Files are replaced whole, so a task can run again anywhere.

Nulls: a null text is one end token; a null doc_id hashes as the empty text. Repeated rows count each, as do
rows of one doc_id. Very long texts are counted and scored whole. Without training rows every token is unknown;
an empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespar.llm._grouped import borders, over_runs
from lodespar.llm._shared import delete, free_shuffles, materialize, new_path
from lodespar.llm._words import U, Words, mix, slices, texts, bounded
from lodespar.llm.elias_fano import EliasFano, close_arrays, encode, read_arrays, write_arrays

DISCOUNT, LEAST_COUNT = 0.75, 2
#: Bytes of text for a shard, tokens that a worker counts at once, sampled pairs for a shard.
SHARD_BYTES, HELD, SAMPLE = 8 << 20, 1 << 20, 200
#: Shards that make one file.
GROUP = 32
FOLDS, HELD_OUT = 7, 2
END = U(0x656E64206F662074)
#: Quantised log10: 16 bits over twelve decades.
_STEPS = 65535 / 12


def quantise(p: np.ndarray) -> np.ndarray:
    return np.round(np.clip(-np.log10(np.maximum(p, 1e-12)), 0, 12) * _STEPS).astype(np.uint16)


def restore(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (-q.astype(np.float64) / _STEPS)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct longs as differences of fewest whole bytes, and counts above one."""
    steps = np.diff(keys, prepend=keys[:1])
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    more = np.flatnonzero(counts > 1).astype(np.uint32)
    head = np.array([len(keys), width, len(more), int(keys[0])], U)
    return head.tobytes() + more.tobytes() + counts[more].astype(np.uint32).tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width, m, first = (int(x) for x in np.frombuffer(blob, U, 4))
    at = np.frombuffer(blob, np.uint32, m, 32)
    counts = np.ones(n, np.int64)
    counts[at] = np.frombuffer(blob, np.uint32, m, 32 + 4 * m)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, 32 + 8 * m).reshape(n, width)
    return U(first) + np.cumsum(wide.view("<u8").ravel(), dtype=U), counts


def merge(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and summed counts."""
    keys, counts = (np.concatenate(x) for x in zip(*map(unpack, blobs)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = borders(keys)[:-1]
    return keys[first], np.add.reduceat(counts, first)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    cut = borders(keys)
    return keys[cut[:-1]], np.diff(cut)


def held_out(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if v is None else str(v).encode()) % FOLDS == HELD_OUT for v in ids.to_pylist()], bool)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a slice, and the first of each text: words, then the end."""
    words = Words(data, offsets, lower=True)
    n = len(offsets) - 1
    out = np.full(len(words.start) + n, END, U)
    first = words.first + np.arange(n + 1)
    inner = np.ones(len(out), bool)
    inner[first[1:] - 1] = False
    out[inner] = words.hashes()
    return out, first


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> U(32)) * U(ranges)) >> U(32)


@dataclass
class Trie:
    """Where the files are and how to number their contents; small: a few numbers a shard."""

    root: str
    shards: int
    #: Number of the first word of each file, and of all words.
    word_starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    n_words: int = 0
    n_tokens: int = 0
    #: Least pair key u * n_words + v of each shard; every GROUP-th is a file's.
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(1, U))
    #: What is left by words whose pairs lie in several files.
    split: dict[int, float] = field(default_factory=dict)

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and count of each of the sorted hashes."""
        out, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        part = _range_of(h, self.shards).astype(np.int64) // GROUP
        cut = borders(part)
        for lo, hi in zip(cut[:-1], cut[1:]):
            g = int(part[lo])
            if g + 1 < len(self.word_starts) and self.word_starts[g] < self.word_starts[g + 1]:
                arrays = read_arrays(f"{self.root}/words/{g}")
                at = sequence(f"{self.root}/words/{g}", "hash").find(h[lo:hi])
                out[lo:hi] = np.where(at >= 0, at + self.word_starts[g], -1)
                count[lo:hi] = np.where(at >= 0, arrays["count"][np.maximum(at, 0)], 0)
        return out, count

    def text_ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, back = np.unique(h, return_inverse=True)
        ids, count = self.ids(distinct)
        return ids[back], count[back]

    def key(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return u.astype(U) * U(self.n_words) + v.astype(U)

    def words_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (keys // U(self.n_words)).astype(np.int64), (keys % U(self.n_words)).astype(np.int64)

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, keys, "right") - 1

    @property
    def files(self) -> int:
        return -(-len(self.bounds) // GROUP)


_SEQUENCES: dict[tuple[str, str], EliasFano] = {}


def sequence(path: str, name: str) -> EliasFano:
    """A worker's sequences, made once."""
    if (path, name) not in _SEQUENCES:
        _SEQUENCES[path, name] = EliasFano(read_arrays(path), name)
    return _SEQUENCES[path, name]


def relative(pointers: EliasFano, words: EliasFano, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Index of ``word`` in the range of ``context`` (an index), -1 if it is not there."""
    ctx, back = np.unique(context, return_inverse=True)
    lo, hi = pointers.access(ctx), pointers.access(ctx + 1)
    before = np.where(lo > 0, words.access(np.maximum(lo.astype(np.int64) - 1, 0)), U(0)) if len(words) else np.zeros(len(lo), U)
    at = words.find(word.astype(U) + before[back] + U(1))
    return np.where((at >= lo[back].astype(np.int64)) & (at < hi[back].astype(np.int64)), at, -1)


def find_pair(path: str, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of u, index of the pair) in a file, -1 where missing."""
    first = sequence(path, "u").find(u)
    out = np.full(len(u), -1, np.int64)
    some = first >= 0
    if some.any():
        out[some] = relative(sequence(path, "u_to"), sequence(path, "v"), first[some], v[some])
    return first, out


def find_triple(path: str, pair: np.ndarray, w: np.ndarray) -> np.ndarray:
    return relative(sequence(path, "v_to"), sequence(path, "w"), pair, w)


class Chain:
    """Ids that rise within each range, as one rising sequence: each range goes on after the last
    number of the one before. Filled shard by shard; a range may go on in the next shard."""

    def __init__(self, n: int):
        self.values, self.n, self.context, self.base = np.zeros(n, U), 0, -1, U(0)

    def add(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where the ranges (runs of ``context``) of these ids begin."""
        cut = borders(context)
        starts, last = cut[:-1], cut[1:] - 1
        base = np.concatenate([np.zeros(1, U), np.cumsum(ids[last].astype(U) + U(1))[:-1]])
        if self.n:
            base += self.base if context[0] == self.context else self.values[self.n - 1]
        self.values[self.n : self.n + len(ids)] = ids.astype(U) + U(1) + np.repeat(base, np.diff(cut))
        self.n, self.context, self.base = self.n + len(ids), int(context[-1]), base[-1]
        return starts


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of runs of training texts: (hashes, first of each text)."""
    held, firsts, n = [], [], 0
    for batch in batches:
        train = np.flatnonzero(~held_out(batch.column(0)))
        if not len(train):
            continue
        for _, _, data, offsets in slices(texts(batch.column(1).take(pa.array(train)))):
            h, first = tokens(data, offsets)
            held.append(h)
            firsts.append(first[:-1] + n)
            n += len(h)
            if n >= HELD:
                yield np.concatenate(held), np.append(np.concatenate(firsts), n)
                held, firsts, n = [], [], 0
    if held:
        yield np.concatenate(held), np.append(np.concatenate(firsts), n)


def _inside(first: np.ndarray, n: int, order: int) -> np.ndarray:
    """Starts of the runs of ``order`` tokens within a text."""
    ok = np.ones(max(0, n - order + 1), bool)
    for k in range(1, order):
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return np.flatnonzero(ok)


def _count_words(ranges: int, sample: int):
    """Blobs of word counts by hash range; pairs of hashes whose hash falls in the sample (negative parts)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, first in _training(batches):
            keys, counts = counted(h)
            part = _range_of(keys, ranges)
            cut = borders(part)
            yield _blobs([(int(part[lo]), pack(keys[lo:hi], counts[lo:hi])) for lo, hi in zip(cut[:-1], cut[1:])])
            at = _inside(first, len(h), 2)
            # Each token is drawn for its own place, so that a pair is drawn as often as it occurs.
            drawn = at[mix(h[at] ^ (h[at + 1] * U(0x9E3779B97F4A7C15)) ^ mix(at.astype(U))) < U(min(sample, (1 << 64) - 1))]
            if len(drawn):
                yield _blobs([(-1 - int(h[drawn[0]] % U(ranges)), np.stack([h[drawn], h[drawn + 1]], 1).tobytes())])

    return work


def _sampled_keys(trie: Trie):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                pairs = np.frombuffer(blob.as_buffer(), U).reshape(-1, 2)
                u, v = trie.text_ids(pairs[:, 0])[0], trie.text_ids(pairs[:, 1])[0]
                yield pa.RecordBatch.from_arrays([pa.array(trie.key(u, v).view(np.int64))], ["key"])

    return work


def _every(n: int):
    """Each n-th key of a sorted partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            first = -(seen + 1) % n
            yield batch.slice(first).take(pa.array(np.arange(0, max(batch.num_rows - first, 0), n))) if first < batch.num_rows else batch.slice(0, 0)
            seen += batch.num_rows

    return work


def _keep_words(root: str):
    """A shard's words to a file; its numbers, and the sampled pairs as they came."""

    def work(table: pa.Table) -> pa.RecordBatch:
        part, blobs, out = table["part"].to_numpy(), table["blob"].to_pylist(), []
        cut = borders(part)
        for lo, hi in zip(cut[:-1], cut[1:]):
            if part[lo] < 0:
                out += [(-1, 0, b) for b in blobs[lo:hi]]
                continue
            keys, counts = merge(blobs[lo:hi])
            write_arrays(f"{root}/counts/words-{part[lo]}", {"key": keys, "count": counts.astype(np.uint32 if counts.max() < 1 << 32 else np.int64)})
            out.append((int(part[lo]), int(counts.sum()), None))
        part, total, blob = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total, pa.int64()), pa.array(blob, pa.binary())], ["part", "total", "blob"])

    return work


def _shards_of(root: str, level: str, file: int, shards: int) -> list[tuple[int, dict[str, np.ndarray]]]:
    """The shards of a file that have anything, in order."""
    found = []
    for part in range(file * GROUP, min((file + 1) * GROUP, shards)):
        try:
            found.append((part, read_arrays(f"{root}/counts/{level}-{part}")))
        except FileNotFoundError:
            continue
    return found


def _per_file(spark, files: int, make, schema: str) -> DataFrame:
    """``make(file)`` -> rows, one task for each file of the trie."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = make(file)
                kinds = [pa.float64() if c.split()[1] == "double" else pa.int64() for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return spark.range(0, files, 1, files).mapInArrow(bounded(work), schema)


def _join_words(root: str, shards: int):
    def make(file: int) -> list[tuple]:
        parts = [a for _, a in _shards_of(root, "words", file, shards)]
        keys = np.concatenate([a["key"] for a in parts]) if parts else np.zeros(0, U)
        counts = np.concatenate([a["count"] for a in parts]) if parts else np.zeros(0, np.uint32)
        write_arrays(f"{root}/words/{file}", encode(keys, "hash") | {"count": counts})
        return [(file, len(keys))]

    return make


def _count_pairs(trie: Trie):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, first in _training(batches):
            ids, _ = trie.text_ids(h)
            at = _inside(first, len(h), 2)
            if not len(at):
                continue
            keys, counts = counted(trie.key(ids[at], ids[at + 1]))
            part = trie.shard(keys)
            cut = borders(part)
            yield _blobs([(int(part[lo]), pack(keys[lo:hi], counts[lo:hi])) for lo, hi in zip(cut[:-1], cut[1:])])

    return work


def _keep_counts(root: str, level: str, least: int):
    def work(table: pa.Table) -> pa.RecordBatch:
        part, blobs = table["part"].to_numpy(), table["blob"].to_pylist()
        cut = borders(part)
        for lo, hi in zip(cut[:-1], cut[1:]):
            keys, counts = merge(blobs[lo:hi])
            keep = counts >= least
            keys, counts = keys[keep], counts[keep]
            more = np.flatnonzero(counts > 1)
            write_arrays(f"{root}/counts/{level}-{part[lo]}", encode(keys, "key") | {"more": more.astype(np.uint32), "above": counts[more]})
        return pa.RecordBatch.from_arrays([pa.array(np.unique(part))], ["part"])

    return work


def _counts_of(arrays: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A shard's keys and counts as ``_keep_counts`` left them."""
    keys = EliasFano(arrays, "key")
    counts = np.ones(len(keys), np.int64)
    counts[arrays["more"]] = arrays["above"]
    return keys.access(np.arange(len(keys))), counts


def _word_counts(trie: Trie, ids: np.ndarray) -> np.ndarray:
    """Counts of sorted word numbers."""
    out = np.zeros(len(ids), np.int64)
    part = np.searchsorted(trie.word_starts, ids, "right") - 1
    cut = borders(part)
    for lo, hi in zip(cut[:-1], cut[1:]):
        g = int(part[lo])
        out[lo:hi] = read_arrays(f"{trie.root}/words/{g}")["count"][ids[lo:hi] - trie.word_starts[g]]
    return out


def _join_pairs(trie: Trie):
    def make(file: int) -> list[tuple]:
        """A file's pairs; what its first and last word keep, as their pairs may go on elsewhere."""
        parts = _shards_of(trie.root, "pairs", file, len(trie.bounds))
        sizes = np.zeros(GROUP + 1, np.int64)
        for part, a in parts:
            sizes[part - file * GROUP + 1] = a["key.head"][0]
        ends, link = np.cumsum(sizes), Chain(int(sizes.sum()))
        pair, all_counts = np.zeros(ends[-1], np.uint16), np.zeros(ends[-1], np.uint32 if all(a["above"].max(initial=0) < 1 << 32 for _, a in parts) else np.int64)
        words, begins, sums, totals = [], [], [], []
        for part, a in parts:
            at, (keys, counts) = ends[part - file * GROUP], _counts_of(a)
            if not len(keys):
                continue
            u, v = trie.words_of(keys)
            starts = link.add(u, v)
            of = _word_counts(trie, u[starts])
            pair[at : at + len(u)] = quantise((counts - DISCOUNT) / np.repeat(of, np.diff(starts, append=len(u))))
            all_counts[at : at + len(u)] = counts
            words.append(u[starts]), begins.append(starts + at), sums.append(np.add.reduceat(counts - DISCOUNT, starts)), totals.append(of)
        words, begins, sums, totals = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, begins, sums, totals))
        # A word whose pairs lie in two shards stands here twice.
        once = borders(words)[:-1]
        firsts, to, of = words[once], np.append(begins[once], ends[-1]), totals[once]
        kept = np.add.reduceat(sums, once) if len(once) else np.zeros(0)
        arrays = encode(firsts, "u") | encode(to, "u_to") | encode(link.values, "v")
        more = np.flatnonzero(all_counts > 1)
        arrays |= {"pair": pair, "left_u": quantise(1 - kept / np.maximum(of, 1)), "more": more.astype(np.uint32), "above": all_counts[more], "shards": ends}
        write_arrays(f"{trie.root}/pairs/{file}", arrays)
        close_arrays(*(f"{trie.root}/counts/pairs-{part}" for part, _ in parts))
        return [(file, int(firsts[i]), float(kept[i]), int(of[i])) for i in sorted({0, len(firsts) - 1})] if len(firsts) else []

    return make


def _files_of(trie: Trie, keys: np.ndarray) -> Iterator[tuple[slice, int]]:
    """Slices of the sorted pair keys by file."""
    file = trie.shard(keys) // GROUP
    cut = borders(file)
    for lo, hi in zip(cut[:-1], cut[1:]):
        yield slice(lo, hi), int(file[lo])


def _count_triples(trie: Trie):
    """Triples whose two pairs were kept, as (index of the first pair in its file, third word), by the
    first pair's shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, first in _training(batches):
            ids, _ = trie.text_ids(h)
            at = _inside(first, len(h), 2)
            if not len(at):
                continue
            keys, back = np.unique(trie.key(ids[at], ids[at + 1]), return_inverse=True)
            u, v = trie.words_of(keys)
            place, index = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
            for some, file in _files_of(trie, keys):
                path = f"{trie.root}/pairs/{file}"
                index[some] = find_pair(path, u[some], v[some])[1]
                place[some] = file * GROUP + np.searchsorted(read_arrays(path)["shards"], index[some], "right") - 1
            of = np.full(len(h), -1, np.int64)
            of[at] = back
            start = _inside(first, len(h), 3)
            start = start[(index[of[start]] >= 0) & (index[of[start + 1]] >= 0)]
            if not len(start):
                continue
            pair, w = of[start], ids[start + 2]
            order = np.argsort(place[pair], kind="stable")
            pair, w = pair[order], w[order]
            cut = borders(place[pair])
            rows = []
            for lo, hi in zip(cut[:-1], cut[1:]):
                triples, counts = counted(index[pair[lo:hi]].astype(U) * U(trie.n_words) + w[lo:hi].astype(U))
                rows.append((int(place[pair[lo]]), pack(triples, counts)))
            yield _blobs(rows)

    return work


def _join_triples(trie: Trie):
    def make(file: int) -> list[tuple]:
        old = read_arrays(f"{trie.root}/pairs/{file}")
        of = np.ones(len(old["pair"]), old["above"].dtype)
        of[old["more"]] = old["above"]
        parts = _shards_of(trie.root, "triples", file, len(trie.bounds))
        n, at = sum(int(a["key.head"][0]) for _, a in parts), 0
        link, triple, kept, sizes = Chain(n), np.zeros(n, np.uint16), np.zeros(len(of)), np.zeros(len(of), np.int64)
        for _, a in parts:
            keys, counts = _counts_of(a)
            if not len(keys):
                continue
            index, w = trie.words_of(keys)
            starts = link.add(index, w)
            triple[at : at + len(w)] = quantise((counts - DISCOUNT) / of[index])
            kept[index[starts]] = np.add.reduceat(counts - DISCOUNT, starts)
            sizes[index[starts]] = np.diff(starts, append=len(w))
            at += len(w)
        arrays = {"left_v": quantise(1 - kept / of), "triple": triple} | encode(np.concatenate([[0], np.cumsum(sizes)]), "v_to") | encode(link.values, "w")
        write_arrays(f"{trie.root}/triples/{file}", arrays)
        close_arrays(*(f"{trie.root}/counts/triples-{part}" for part, _ in parts))
        return [(file, n)]

    return make


def _score(trie: Trie):
    base_of = np.log10(trie.n_tokens + trie.n_words + 1)

    def one(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score and score of each text of a slice."""
        ids, count = trie.text_ids(h)
        p1 = (count + 1) / (trie.n_tokens + trie.n_words + 1)
        p = p1.copy()
        at = _inside(first, len(h), 2)
        at = at[ids[at] >= 0]
        # Unknown words follow their context with what it leaves only; they get a number of their own.
        unknown = trie.n_words
        if len(at):
            v_all = np.where(ids[at + 1] >= 0, ids[at + 1], unknown)
            both = ids[at].astype(U) * U(trie.n_words + 1) + v_all.astype(U)
            keys, back = np.unique(both, return_inverse=True)
            u, v = (keys // U(trie.n_words + 1)).astype(np.int64), (keys % U(trie.n_words + 1)).astype(np.int64)
            shard_keys = trie.key(u, np.minimum(v, trie.n_words - 1))
            a2, b2, place, index = np.zeros(len(keys)), np.ones(len(keys)), np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
            left = np.ones(len(keys))
            for some, file in _files_of(trie, shard_keys):
                path = f"{trie.root}/pairs/{file}"
                arrays, below = read_arrays(path), read_arrays(f"{trie.root}/triples/{file}")
                i, j = find_pair(path, u[some], v[some])
                j = np.where(v[some] < unknown, j, -1)
                place[some], index[some] = file, j
                if len(arrays["pair"]):
                    a2[some] = np.where(j >= 0, restore(arrays["pair"][np.maximum(j, 0)]), 0.0)
                    b2[some] = np.where(j >= 0, restore(below["left_v"][np.maximum(j, 0)]), 1.0)
                    left[some] = np.where(i >= 0, restore(arrays["left_u"][np.maximum(i, 0)]), 1.0)
            for word, value in trie.split.items():
                lo, hi = np.searchsorted(u, [word, word + 1])
                left[lo:hi] = value
            p[at + 1] = a2[back] + left[back] * p1[at + 1]
            # Third words: contexts are pairs of the trie.
            of = np.full(len(h), -1, np.int64)
            of[at] = back
            start = _inside(first, len(h), 3)
            start = start[of[start] >= 0]
            start = start[index[of[start]] >= 0]
            a3 = np.zeros(len(start))
            pair, w = of[start], ids[start + 2]
            order = np.argsort(place[pair], kind="stable")
            cut = borders(place[pair[order]])
            for lo, hi in zip(cut[:-1], cut[1:]):
                mine = order[lo:hi]
                path = f"{trie.root}/triples/{place[pair[mine[0]]]}"
                mine = mine[w[mine] >= 0]
                if not len(mine) or not len(sequence(path, "w")):
                    continue
                triples, again = np.unique(index[pair[mine]].astype(U) * U(trie.n_words) + w[mine].astype(U), return_inverse=True)
                found = find_triple(path, *trie.words_of(triples))
                value = np.where(found >= 0, restore(read_arrays(path)["triple"][np.maximum(found, 0)]), 0.0)
                a3[mine] = value[again]
            p[start + 2] = a3 + b2[pair] * p[start + 2]
        sums = lambda x: np.add.reduceat(x, first[:-1])
        return np.diff(first), sums((count > 0).astype(np.int64)), sums(np.log10(count + 1)) - np.diff(first) * base_of, sums(np.log10(p))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = held_out(batch.column(0))
            for i, j, data, offsets in slices(texts(batch.column(1))):
                n, known, base, score = one(*tokens(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out[i:j]), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(j - i, trie.n_tokens, np.int64)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return work


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def train(docs: DataFrame, least: int = LEAST_COUNT) -> Trie:
    """The trie of the training rows of ``docs``: pairs and triples of ``least`` occurrences at least."""
    spark, rows = docs.sparkSession, _rows(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    trie = Trie(new_path(spark, "lm"), shards)
    # About a token for six bytes; SAMPLE pairs for each shard.
    sample = int((1 << 64) * min(1.0, SAMPLE * shards * 6 / max(size, 1)))
    blobs = rows.mapInArrow(bounded(_count_words(shards, sample)), "part long, blob binary")
    told = materialize(over_runs(blobs, "part", [], _keep_words(trie.root), "part long, total long, blob binary"), "lm-told")
    trie.n_tokens = told.agg(F.sum("total")).first()[0] or 0
    files = -(-shards // GROUP)
    sizes = dict(map(tuple, _per_file(spark, files, _join_words(trie.root, shards), "file long, n long").collect()))
    delete(spark, f"{trie.root}/counts")
    free_shuffles(spark)
    trie.word_starts = np.concatenate([[0], np.cumsum([sizes[f] for f in range(files)])])
    trie.n_words = int(trie.word_starts[-1])
    if not trie.n_words:
        return trie
    keys = materialize(told.where("part < 0").select("blob").mapInArrow(bounded(_sampled_keys(trie)), "key long"), "lm-keys")
    every = max(1, -(-keys.count() // shards))
    ordered = keys.repartitionByRange(-(-shards // GROUP), "key").sortWithinPartitions("key")
    cuts = [r["key"] for r in ordered.mapInArrow(bounded(_every(every)), "key long").collect()]  # about one a shard
    trie.bounds = np.unique(np.array([0, *cuts], U))
    over_runs(rows.mapInArrow(bounded(_count_pairs(trie)), "part long, blob binary"), "part", [], _keep_counts(trie.root, "pairs", least), "part long").collect()  # a number a shard
    ends = _per_file(spark, trie.files, _join_pairs(trie), "file long, word long, kept double, total long").collect()  # two words a file
    delete(spark, f"{trie.root}/counts")
    free_shuffles(spark)
    parts: dict[int, dict[int, float]] = {}
    totals = {}
    for r in ends:
        parts.setdefault(r["word"], {})[r["file"]] = r["kept"]
        totals[r["word"]] = r["total"]
    trie.split = {w: 1 - sum(k.values()) / totals[w] for w, k in parts.items() if len(k) > 1}
    over_runs(rows.mapInArrow(bounded(_count_triples(trie)), "part long, blob binary"), "part", [], _keep_counts(trie.root, "triples", least), "part long").collect()
    _per_file(spark, trie.files, _join_triples(trie), "file long, n long").collect()
    delete(spark, f"{trie.root}/counts")
    free_shuffles(spark)
    return trie


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    return _rows(docs).mapInArrow(bounded(_score(trie)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_corpus(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    return score(docs, train(docs, least))
