"""A quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; the model has a lookup table over the bins of each feature
and, for the pairs that explain most of what is left, a table over coarser bins of both. The tables are
learnt by cyclic boosting: round after round, every feature in turn gets a tree of at most four leaves
on its bins, fitted to the current gradient and added at a small rate; then the pairs likewise. A score
is a sum of looked-up cells through the logistic function.

The features are counts over a text's bytes and words; labels, language, source and id are never among
them. The model is fitted on the driver, on at most ``MOST_ROWS`` labelled rows, those of least seeded hash
of doc_id; its size is fixed by the number of features. Only the texts of those rows are looked up for it.
Scoring is a column over the scan: features, bins and sums of a batch of texts at once, no shuffle and no
table between.

Nulls: a null text is empty, a null doc_id is held out or not as the empty text is. Empty texts are scored
like any other, very long ones whole. Rows without a label, or with a null one, teach nothing; several
labels of a document count by their maximum, and ties in the seeded hash go by doc_id and text. Without
both classes among the labels, every score is the (smoothed) share of label 1. Repeated rows are scored
each, rows of one doc_id by their own texts. An empty table gives an empty result. Other columns, whatever
their names, are ignored, or passed on by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespar.llm._shared import materialize, seeded_hash
from lodespar.llm._words import Words, by_text, slices, texts, windows, bounded

MOST_ROWS, ACCEPT = 20_000, 0.7
FOLDS, HELD_OUT = 4, 2
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 48, 8, 6, 200, 60, 0.08, 3.0
FEATURES = ["words", "word_length", "letters", "upper", "digits", "marks", "odd_marks", "bars", "shouts", "lines", "above_ascii", "entropy", "distinct", "again", "commonest", "repeated_threes", "short_words", "sentence_ends", "odd_ends"]

_KIND = {"letter": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "mark": bytes(c for c in range(33, 127) if not chr(c).isalnum()), "odd": b"#$%&*+<=>@[\\]^_`{|}~", "bar": b"|", "shout": b"!", "line": b"\n", "end": b".!?", "odd_end": b"#$%&*|~^"}
_IS = {k: np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(v, np.uint8)) for k, v in _KIND.items()}


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, features) of a slice of texts."""
    n, size = len(offsets) - 1, np.diff(offsets)
    doc = by_text(size)
    table = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    count = lambda kind: table[:, _IS[kind]].sum(1)
    words = Words(data, offsets, lower=True)
    h, first, k = words.hashes(), words.first, words.counts
    of = by_text(k)
    per = np.maximum(k, 1)
    length = np.bincount(of, words.end - words.start, minlength=n)
    share = np.divide(table, np.maximum(size, 1)[:, None])
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)

    def runs(x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of each text, and its commonest's count."""
        order = np.lexsort((x, owner))
        x, owner = x[order], owner[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        most = np.zeros(n)
        np.maximum.at(most, owner[at], np.diff(np.append(at, len(x))))
        return np.bincount(owner[at], minlength=n), most

    distinct, most = runs(h, of)
    threes, _, n3 = windows(h, first, 3)
    distinct3, _ = runs(threes, by_text(n3))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    last = data[words.end - 1] if len(h) else np.zeros(0, np.uint8)
    per_word = lambda flag: np.bincount(of, flag, minlength=n) / per
    solid = np.maximum(length, 1)
    letters = count("letter")
    return np.stack([
        np.log1p(k), length / per, (letters + table[:, 128:].sum(1)) / solid, count("upper") / np.maximum(letters, 1),
        count("digit") / solid, count("mark") / solid, count("odd") / solid, count("bar") / solid, count("shout") / solid,
        count("line") / per, table[:, 128:].sum(1) / solid, entropy, distinct / per, per_word(same), most / per,
        1 - distinct3 / np.maximum(n3, 1), per_word((words.end - words.start) <= 3), per_word(_IS["end"][last]), per_word(_IS["odd_end"][last]),
    ], 1)


def measure(column: pa.Array) -> np.ndarray:
    """(texts, features), a slice at a time."""
    found = [features(data, offsets).astype(np.float32) for _, _, data, offsets in slices(texts(column))]
    return np.concatenate(found) if found else np.zeros((0, len(FEATURES)), np.float32)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = measure(batch.column("text"))
        lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("quality"), lists], ["quality", "x"])


@dataclass
class Model:
    """``edges`` of bins by feature, ``tables`` by feature, and ``pairs`` with their ``grids``."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.bins(x, self.edges), self.bins(x, self.coarse)
        total = np.full(len(x), self.start)
        for f, table in enumerate(self.tables):
            total += table[fine[:, f]]
        for (a, b), grid in zip(self.pairs, self.grids):
            total += grid[coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins).astype(np.float32))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Best place to split a run of bins in two, and its gain."""
    if len(g) < 2:
        return 0, 0.0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(gain.argmax())
    return at + 1, float(gain[at])


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to four leaves over ordered bins: its step for each bin."""
    step = np.zeros(len(g))
    middle, gain = _cut(g, h)
    borders = [0, len(g)]
    if gain > 0:
        borders.insert(1, middle)
        for lo, hi in ((0, middle), (middle, len(g))):
            at, gain = _cut(g[lo:hi], h[lo:hi])
            if gain > 0:
                borders.append(lo + at)
    borders = sorted(borders)
    for lo, hi in zip(borders[:-1], borders[1:]):
        step[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best of trees that split one feature and then the other on either side, on a grid."""
    best, found = np.zeros(g.shape), 0.0
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        rows_g, rows_h = np.cumsum(gg, 0), np.cumsum(hh, 0)
        for at in range(1, len(gg)):
            step, gain = np.empty(gg.shape), 0.0
            for lo, hi, sg, sh in ((0, at, rows_g[at - 1], rows_h[at - 1]), (at, len(gg), rows_g[-1] - rows_g[at - 1], rows_h[-1] - rows_h[at - 1])):
                cut, _ = _cut(sg, sh)
                for a, b in ((0, cut), (cut, len(sg))):
                    step[lo:hi, a:b] = sg[a:b].sum() / (sh[a:b].sum() + RIDGE)
                    gain += _gain(sg[a:b].sum(), sh[a:b].sum())
            if gain > found:
                best, found = (step.T if flip else step), gain
    return best, found - float(_gain(g.sum(), h.sum()))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    n = x.shape[1] if len(x) else len(FEATURES)
    p = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(p / (1 - p)))
    edges = [_quantiles(x[:, f], BINS) if len(x) else np.zeros(0) for f in range(n)]
    coarse = [_quantiles(x[:, f], PAIR_BINS) if len(x) else np.zeros(0) for f in range(n)]
    model = Model(start, edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], [])
    if len(np.unique(y)) < 2:
        return model
    fine, rough = model.bins(x, edges), model.bins(x, coarse)
    total = np.full(len(y), start)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(ROUNDS):
        for f in range(n):
            g, h = gradient()
            size = len(model.tables[f])
            step = RATE * _tree(np.bincount(fine[:, f], g, size), np.bincount(fine[:, f], h, size))
            model.tables[f] += step
            total += step[fine[:, f]]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = rough[:, a] * shape[1] + rough[:, b]
        g, h = gradient()
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), cell

    gains = {pair: _pair_tree(*grid(*pair)[:2])[1] for pair in combinations(range(n), 2)}
    model.pairs = sorted(gains, key=gains.get, reverse=True)[:PAIRS]
    model.grids = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for i, pair in enumerate(model.pairs):
            g, h, cell = grid(*pair)
            step = RATE * _pair_tree(g, h)[0]
            model.grids[i] += step
            total += step.ravel()[cell]
    return model


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, seed: int = 17) -> Model:
    """The model of the labelled rows of ``docs`` that are not held out, of at most ``most_rows`` of them."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    here = docs.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"))
    by_hash = [seeded_hash(seed, F.col("doc_id")), F.col("doc_id")]
    chosen = materialize(known.join(here, "doc_id", "left_semi").orderBy(*by_hash).limit(most_rows), "quality-rows")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(chosen, "doc_id")
    rows = rows.orderBy(*by_hash, F.xxhash64("text")).limit(most_rows).select("quality", "text")
    taken = rows.mapInArrow(bounded(_measure), f"quality {chosen.schema['quality'].dataType.simpleString()}, x array<float>").toPandas()
    return fit(np.array(taken["x"].tolist(), np.float32).reshape(len(taken), len(FEATURES)), taken["quality"].to_numpy(np.float64))


def score(text: Column, model: Model) -> Column:
    """Scores of texts, 0 to 1."""
    work = bounded(lambda columns: (pa.array(model.score(measure(c))) for c in columns))

    @F.arrow_udf("double")
    def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return work(columns)

    return scores(text.cast("binary"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score(F.col("text"), train(docs, labels)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are accepted, each by its own text."""
    return docs.where(score(F.col("text"), train(docs, labels)) >= ACCEPT)
