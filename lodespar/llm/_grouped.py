"""Arrow groups without a call per group: rows are dealt and sorted by a key, and a generator walks
the runs of equal keys across batch borders. Callers keep every group to a bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodespar.llm._words import bounded


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of ``key`` (one or many runs each, never part of one)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[-1].as_py() == k[0] == k[-1]:
            held.append(batch)
            continue
        last = len(k) - int(np.argmax(k[::-1] != k[-1])) if k[0] != k[-1] else 0
        if last or held:
            if last:
                held.append(batch.slice(0, last))
                yield pa.Table.from_batches(held)
                held = []
            elif held[-1].column(key)[-1].as_py() != k[0]:
                yield pa.Table.from_batches(held)
                held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def borders(k: np.ndarray) -> np.ndarray:
    """Where the runs of ``k`` begin, and its length."""
    return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]]) if len(k) else np.zeros(1, int)


def over_runs(df: DataFrame, key: str, order: list[str], fn: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over tables of whole runs of the (long) key, each run sorted by ``order``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, key):
            yield fn(table.combine_chunks())

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(bounded(work), schema)
