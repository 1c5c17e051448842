"""Near-duplicate documents by b-bit MinHash over five-word shingles.

1. A pass over the texts gives each document its set's size and digest, 256 minima as ``B`` low bits
   each (a packed signature), and 64 keys of bands of 4 whole minima. Documents of equal sets are one
   node from here on, so exact copies never meet each other again.
2. Nodes that share a band are candidates. A band of m nodes is first tried as a star: m - 1 pairs
   with its least node. Pairs whose collision-corrected signature estimate is within six standard
   deviations of the threshold are confirmed on the full sets; confirmed links give components.
3. Bands that still hold several components are gone through completely, in blocks of bounded size:
   signatures tell which node could be linked to which other component, each such (node, component)
   is tried once on full sets, against all its members, again in blocks. No list of pairs of a group
   is ever made, and none of its pairs is left out.

At similarity 0.75 a pair shares no band with a chance of (1 - 0.75**4)**64, 3e-11, and is missed by
the estimate with about 1e-9.

Full sets are made only for nodes that share a band, in a second pass over the texts. What crosses a
shuffle is a signature a document, 64 keys a node, and the sets of colliding nodes.

Nulls: a row without doc_id is linked with nothing and kept. A null or blank text has no shingles
and is linked with nothing. Very long texts are handled one at a time, their sets whole. Rows of equal
doc_id are one document: ``near_duplicates`` puts them in one component, whatever their texts, with a row
of the result for each. ``drop_near_duplicates`` decides on texts instead, so that no text is lost because
another row has its doc_id. An empty table gives an empty result. Other columns, whatever their names, are
ignored or passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespar.llm._grouped import borders, over_runs
from lodespar.llm._shared import free_shuffles, materialize, own
from lodespar.llm._words import U, Words, mix, slices, texts, windows, bounded
from lodespar.llm.components import components

SHINGLE = 5
MINIMA, ROWS, B = 256, 4, 2
BANDS = MINIMA // ROWS
PER_LONG = 64 // B
LONGS = MINIMA // PER_LONG
#: Similarity as a fraction of whole numbers: links have 100 * intersection >= 75 * union.
PERCENT = 75
#: Standard deviation of the estimate at the threshold, and so the least estimate that is confirmed.
_P = 2.0**-B + (1 - 2.0**-B) * PERCENT / 100
LEAST = PERCENT / 100 - 6 * (_P * (1 - _P) / MINIMA) ** 0.5 / (1 - 2.0**-B)
#: Nodes of a block whose signatures are compared; nodes and shingles of a block whose sets are.
BLOCK, FULL_BLOCK, FULL_SHINGLES = 512, 512, 1 << 21
_FACTORS = (mix(np.arange(1, MINIMA + 1, dtype=U)) | U(1)).astype(np.uint32)
_BAND = mix(np.arange(1, BANDS + 1, dtype=U) * U(0xA24BAED4963EE407))
_STEP = 1 << 14


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted set of each text's shingles as hashes."""
    words = Words(data, offsets, lower=True)
    h = words.hashes()
    rolled, _, per = windows(h, words.first, SHINGLE)
    ends = np.cumsum(per)
    for i, n in enumerate(words.counts):
        if n >= SHINGLE:
            yield np.unique(rolled[ends[i] - per[i] : ends[i]])
        else:
            few = h[words.first[i] : words.first[i + 1]]
            whole = U(0x2545F4914F6CDD1D) + U(n)
            for x in few:
                whole = (mix(np.array([whole ^ x], U)) * U(0x9E3779B97F4A7C15))[0]
            yield np.array([whole], U)[: int(n > 0)]


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> U(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _STEP):
        part = x[i : i + _STEP]
        if len(part) <= 2048:
            np.minimum(least, (part[:, None] * _FACTORS).min(0), out=least)
        else:
            for k in range(MINIMA):
                least[k] = min(least[k], (part * _FACTORS[k]).min())
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    m = least.reshape(-1, BANDS, ROWS).astype(U)
    h = np.broadcast_to(_BAND, m.shape[:2]).copy()
    for r in range(ROWS):
        h = mix(h ^ (m[:, :, r] * U(0x9E3779B97F4A7C15)))
    return h


def pack(least: np.ndarray) -> np.ndarray:
    """The low ``B`` bits of the minima (their high bits say how many there are), as longs."""
    low = (mix(least.astype(U)) & U((1 << B) - 1)).reshape(-1, LONGS, PER_LONG)
    return np.bitwise_or.reduce(low << (np.arange(PER_LONG, dtype=U) * U(B)), axis=2)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, column, hashes = batch.column(0), texts(batch.column(1)), batch.column(2)
        for i, j, data, offsets in slices(column):
            size, digest, least = np.zeros(j - i, np.int64), [], np.zeros((j - i, MINIMA), np.uint32)
            for k, s in enumerate(shingle_sets(data, offsets)):
                size[k] = len(s)
                least[k] = minima(s)
                both = np.array([s.sum(dtype=U), mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U), U(len(s))])
                digest.append(both.tobytes() if len(s) else None)
            keys, packed = band_keys(least).view(np.int64), pack(least).view(np.int64)
            lists = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), hashes.slice(i, j - i), pa.array(size), pa.array(digest, pa.binary()), lists(packed), lists(keys)], ["doc_id", "_t", "n_shingles", "digest", "sig", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, column = batch.column(0), texts(batch.column(1))
        for i, j, data, offsets in slices(column):
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([s.tobytes() for s in shingle_sets(data, offsets)], pa.binary())], ["node", "set"])


def estimate(x, y):
    """Similarity from two packed signatures (arrays of longs in the columns x and y)."""
    lanes = (1 << B) - 1
    ones = sum(1 << (B * i) for i in range(PER_LONG))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    differ = F.lit(0)
    for k in range(LONGS):
        d = F.get(x, k).bitwiseXOR(F.get(y, k))
        any_bit = d
        for s in range(1, lanes.bit_length()):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(d, s))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(ones)))
    return (F.lit(1.0) - differ / MINIMA - 2.0**-B) / (1 - 2.0**-B)


def _estimates(sig: np.ndarray) -> np.ndarray:
    """All similarities among rows of a (n, LONGS) array of signatures."""
    ones = U(sum(1 << (B * i) for i in range(PER_LONG)))
    differ = np.zeros((len(sig), len(sig)), np.int32)
    for k in range(LONGS):
        d = sig[:, None, k] ^ sig[None, :, k]
        any_bit = d
        for s in range(1, B):
            any_bit = any_bit | (d >> U(s))
        differ += np.bitwise_count(any_bit & ones)
    return (1 - differ / MINIMA - 2.0**-B) / (1 - 2.0**-B)


def _linked(table: pa.Table) -> pa.RecordBatch:
    """Runs of ``g``: one link from each node of role 1 to one of role 0 that it is similar to."""
    g, node, role = (table[c].to_numpy() for c in ("g", "node", "role"))
    sets = [np.frombuffer(x, U) for x in table["set"].to_pylist()]
    a, b = [], []
    cut = borders(g)
    for lo, hi in zip(cut[:-1], cut[1:]):
        zero, one = [i for i in range(lo, hi) if role[i] == 0], [i for i in range(lo, hi) if role[i] == 1]
        if not zero or not one:
            continue
        sizes = np.array([len(sets[i]) for i in zero])
        every = np.concatenate([sets[i] for i in zero])
        order = np.argsort(every, kind="stable")
        owner, every = np.repeat(np.arange(len(zero)), sizes)[order], every[order]
        for i in one:
            left, right = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
            n = right - left
            at = np.arange(int(n.sum())) + np.repeat(left - (np.cumsum(n) - n), n)
            both = np.bincount(owner[at], minlength=len(zero))
            good = np.flatnonzero((100 * both >= PERCENT * (sizes + len(sets[i]) - both)) & (node[zero] != node[i]))
            if len(good):
                a.append(node[i])
                b.append(node[zero[good[0]]])
    return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], ["a", "b"])


def _confirm(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows: (g, node, role) in groups of bounded size. Links (a, b) of role 1 to role 0."""
    return over_runs(rows.join(sets, "node"), "g", ["role"], _linked, "a long, b long")


def _reach(table: pa.Table) -> pa.RecordBatch:
    """Runs of ``g``: which node may be linked to which other component, by size and estimate; the
    smaller component's node is tied to the larger component. A pair speaks in the group of its two
    blocks, in the first two bands that it shares: bands are compared by 31 bits of their keys, and two false
    agreements before a true one are a chance of 4e-16, one only would be 3e-8."""
    g, node, comp, n, of, band, block, i, j = (table[c].to_numpy() for c in ("g", "node", "component", "n_shingles", "members", "band", "block", "i", "j"))
    sig = table["sig"].combine_chunks().flatten().to_numpy().view(U).reshape(-1, LONGS)
    keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    found = []
    cut = borders(g)
    for lo, hi in zip(cut[:-1], cut[1:]):
        c, m, k, at = comp[lo:hi], n[lo:hi], of[lo:hi], block[lo:hi]
        larger = (k[None, :] > k[:, None]) | ((k[None, :] == k[:, None]) & (c[None, :] > c[:, None]))
        may = larger & (c[None, :] != c[:, None]) & (100 * np.minimum(m[None, :], m[:, None]) >= PERCENT * np.maximum(m[None, :], m[:, None]))
        if i[lo] != j[lo]:
            may &= at[None, :] != at[:, None]
        if may.any():
            x, y = np.nonzero(may & (_estimates(sig[lo:hi]) >= LEAST))
            for part in range(0, len(x), _STEP):
                a, b = x[part : part + _STEP], y[part : part + _STEP]
                new = (keys[lo + a, : band[lo]] == keys[lo + b, : band[lo]]).sum(1) < 2
                found.append(np.unique(np.stack([node[lo + a[new]], comp[lo + b[new]]], 1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["node", "target"])


def _blocks(count) -> F.Column:
    return F.ceil(count / BLOCK).cast("int")


def _full_blocks(nodes, shingles) -> F.Column:
    """Blocks that hold a bounded number of nodes and, but for single large ones, of bytes."""
    return F.greatest(F.ceil(nodes / FULL_BLOCK), F.ceil(shingles / FULL_SHINGLES)).cast("int")


def _block_of(node, blocks):
    return F.pmod(F.xxhash64(node), blocks).cast("int")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, and the text's hash: what tells the rows of one doc_id apart."""
    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_t"))


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with their digests; nodes (one for each set: digest, node, and its least row's doc_id and ``_t``);
    links between nodes (a, b); and the components of those."""
    signed = materialize(_texts(docs).mapInArrow(bounded(_sign), "doc_id long, _t long, n_shingles long, digest binary, sig array<long>, bands array<long>"), "near-signed")
    real = signed.where("doc_id is not null and digest is not null")
    nodes = real.groupBy("digest").agg(F.min(F.struct("doc_id", "_t")).alias("_f"), F.min_by(F.struct("n_shingles", "sig", "bands"), F.struct("doc_id", "_t")).alias("_s"))
    # The number of a node is fixed by the table that it is written to.
    nodes = materialize(nodes.select("digest", F.monotonically_increasing_id().alias("node"), "_f.doc_id", "_f._t", "_s.n_shingles", "_s.sig", "_s.bands"), "near-nodes")
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "lead")
    members = materialize(keys.join(materialize(shared, "near-shared"), "key"), "near-members")
    sigs = materialize(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "_t", "n_shingles", "sig", F.transform("bands", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("keys")), "near-sigs")
    # One row stands for a node. Where other rows repeat it whole, they are made one before their sets. Texts meet
    # their nodes by a shuffle at every size, as nodes that share a band grow with the documents.
    need = sigs.select("doc_id", "_t", "node")
    again = materialize(real.groupBy("doc_id", "_t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "_t"), "near-again")
    once = materialize(need.join(again, ["doc_id", "_t"], "left_anti"), "near-once")
    sets = _texts(docs).join(once.hint("merge"), ["doc_id", "_t"]).select("node", "text")
    if again.limit(1).count():
        several = materialize(need.join(again, ["doc_id", "_t"], "left_semi"), "near-several")
        sets = sets.unionByName(_texts(docs).join(several, ["doc_id", "_t"]).groupBy("node").agg(F.first("text").alias("text")))
    sets = materialize(sets.mapInArrow(bounded(_sets), "node long, set binary"), "near-sets")
    free_shuffles(docs.sparkSession)
    sigs = sigs.drop("doc_id", "_t")

    # Stars: every member of a band with its least node.
    pairs = members.where("node <> lead").select("lead", "node").distinct()
    pairs = pairs.join(sigs.select("node", "n_shingles", F.col("sig").alias("y")), "node").join(sigs.select(F.col("node").alias("lead"), F.col("sig").alias("x")), "lead")
    pairs = materialize(pairs.where(estimate(F.col("x"), F.col("y")) >= LEAST).select("lead", "node", "n_shingles"), "near-pairs")
    per = materialize(pairs.groupBy("lead").agg(_full_blocks(F.count(F.lit(1)), F.sum("n_shingles")).alias("_of")), "near-leads")
    ones = pairs.join(per, "lead").select("lead", _block_of("node", F.col("_of")).alias("_b"), "node")
    g = F.xxhash64("lead", "_b").alias("g")
    rows = ones.select(g, "node", F.lit(1).alias("role")).unionByName(ones.select("lead", "_b").distinct().select(g, F.col("lead").alias("node"), F.lit(0).alias("role")))
    links = materialize(_confirm(rows, sets), "near-links")
    labels = components(links)

    # What the stars leave: bands with several components.
    labelled = lambda df: df.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    held = materialize(labelled(sigs), "near-held")
    sized = held.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("_all"))
    held = materialize(held.join(sized.drop("_all"), "component"), "near-held")
    mixed = members.join(held.select("node", "component"), "node").groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_z"), F.count(F.lit(1)).alias("_n")).where("_a <> _z")
    left = members.select("key", "band", "node").join(materialize(mixed.select("key", _blocks(F.col("_n")).alias("_of")), "near-mixed"), "key")
    both = F.explode(F.expr("transform(sequence(0, _of - 1), j -> struct(least(_b, j) as i, greatest(_b, j) as j))"))
    left = left.withColumn("_b", _block_of("node", F.col("_of"))).select(both.alias("_p"), "key", "band", "node", F.col("_b").alias("block"))
    left = left.select(F.xxhash64("key", "_p.i", "_p.j").alias("g"), "band", "node", "block", "_p.i", "_p.j").join(held, "node")
    ties = materialize(over_runs(left, "g", [], _reach, "node long, target long").distinct(), "near-ties")
    ties = ties.join(sigs.select("node", "n_shingles"), "node")
    ones = ties.groupBy("target").agg(_full_blocks(F.count(F.lit(1)), F.sum("n_shingles")).alias("_ones"))
    ties = ties.drop("n_shingles").join(ones, "target").join(sized.select(F.col("component").alias("target"), _full_blocks(F.col("members"), F.col("_all")).alias("_zeros")), "target")
    ties = materialize(ties, "near-ties")
    ones = ties.select("target", "node", _block_of("node", F.col("_ones")).alias("_i"), F.explode(F.expr("sequence(0, _zeros - 1)")).alias("_j"), F.lit(1).alias("role"))
    zeros = held.select(F.col("component").alias("target"), "node").join(ties.select("target", "_ones", "_zeros").distinct(), "target")
    zeros = zeros.select("target", "node", F.explode(F.expr("sequence(0, _ones - 1)")).alias("_i"), _block_of("node", F.col("_zeros")).alias("_j"), F.lit(0).alias("role"))
    more = _confirm(ones.unionByName(zeros).select(F.xxhash64("target", "_i", "_j").alias("g"), "node", "role"), sets)
    more = materialize(more, "near-links")
    if more.limit(1).count():
        links = links.unionByName(more)
        labels = components(links)

    return signed, nodes, links, labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of ``docs``."""
    signed, nodes, links, labels = _groups(docs)
    of = signed.where("doc_id is not null and digest is not null").select("doc_id", "digest")
    several = of.groupBy("doc_id").agg(F.min("digest").alias("_a"), F.max("digest").alias("_z")).where("_a <> _z").select("doc_id")
    several = materialize(several, "near-several")
    if several.limit(1).count():
        # Ids that rows of several texts have: their nodes belong together.
        own = of.join(several, "doc_id").distinct().join(nodes.select("digest", "node"), "digest").select("doc_id", "node")
        tied = own.join(own.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")
        labels = components(links.unionByName(tied.where("a <> b")))
    named = nodes.select("digest", "node", "doc_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("_c"))
    named = materialize(named.join(least, "component").select("digest", "_c"), "near-named")
    out = signed.select("doc_id", "n_shingles", "digest").withColumn("digest", F.when(F.col("doc_id").isNotNull(), F.col("digest"))).join(named, "digest", "left").withColumn("component_id", F.coalesce("_c", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicate texts, the row of least doc_id (ties: of least text hash); of rows
    equal in doc_id and text, one. Rows without doc_id, or whose text has no words, all stay."""
    signed, nodes, _, labels = _groups(docs)
    named = nodes.select("node", "digest", "doc_id", "_t").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "_t")).alias("_f"))
    named = materialize(named.join(first, "component").select("digest", "_f"), "near-named")
    real = signed.where("doc_id is not null and digest is not null").select("doc_id", "_t", "digest")
    # Each distinct row once: whether it goes, or stays but stands there several times.
    rows = real.groupBy("doc_id", "_t").agg(F.first("digest").alias("digest"), F.count(F.lit(1)).alias("_n")).join(named, "digest")
    rows = rows.withColumn("_stays", F.struct("doc_id", "_t") == F.col("_f")).where("_n > 1 or not _stays")
    marked = materialize(rows.select("doc_id", "_t", "_stays"), "near-marked")
    # The caller's columns in one, whatever their names.
    keyed = docs.select(F.struct(*own(docs)).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("binary")).alias("_t"))
    rest = keyed.join(marked, ["doc_id", "_t"], "left_anti").select("_row.*")
    if not marked.where("_stays").limit(1).count():
        return rest
    again = keyed.join(marked.where("_stays"), ["doc_id", "_t"]).groupBy("doc_id", "_t").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return rest.unionByName(again.select("_row.*"))
