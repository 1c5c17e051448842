"""Stratified samples: allocation on counted strata, deterministic picks, splits and slice power.

Counting and picking are distributed. The allocation itself is a short integer procedure over the
strata (eight for posts), done on the driver. Picks order rows by a seeded hash, so they do not depend
on partitions or on a random generator's state.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespar.operators.scoring import margin, verdict

SEED = 20260801
#: Leading hexadecimal digits that rows are counted by.
PREFIX = 4


def shuffle_key(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def sizes(df: DataFrame, stratum: str = "stratum") -> dict[str, int]:
    return {r[0]: r[1] for r in df.groupBy(stratum).count().orderBy(stratum).collect()}  # a row a stratum


def _handed_out(amount: int, room: dict[str, int]) -> dict[str, int]:
    """``amount`` units given to the first keys as far as there is room, then to the next."""
    upto = dict(zip(room, accumulate(room.values(), initial=0)))
    return {k: min(max(amount - upto[k], 0), r) for k, r in room.items()}


def allocate(available: dict[str, int], n: int, oversample: dict[str, int] | None = None) -> dict[str, int]:
    """How many to draw from each stratum, ``n`` in all where the strata allow it.

    Proportional, but at least a floor from each; parts of a stratum's name (between slashes) may be
    brought up to a number, from their largest strata first, and are not shrunk afterwards. The sum is
    brought to ``n`` at the largest strata (growing) or the smallest (shrinking).
    """
    total, floor = sum(available.values()), max(2, n // (3 * max(len(available), 1)))
    falling = sorted(available, key=lambda k: -available[k])
    take = {k: min(available[k], max(floor, round(n * available[k] / total))) for k in falling}
    held: set[str] = set()
    for part, goal in (oversample or {}).items():
        cells = [k for k in falling if part in k.split("/")]
        more = _handed_out(goal - sum(take[k] for k in cells), {k: available[k] - take[k] for k in cells})
        take |= {k: take[k] + more[k] for k in cells}
        held.update(cells)
    short = n - sum(take.values())
    more = _handed_out(short, {k: available[k] - take[k] for k in falling})
    less = _handed_out(-short, {k: max(take[k] - floor, 0) for k in reversed(falling) if k not in held})
    return {k: take[k] + more[k] - less.get(k, 0) for k in available}


def pick(df: DataFrame, allocation: dict[str, int], key: str, stratum: str = "stratum", seed: int = SEED) -> DataFrame:
    """The first rows of each stratum in seeded order. The largest allocation bounds what a task sends on of a
    stratum, before the stratum is one task's."""
    wanted = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in allocation.items() for x in pair]), F.col(stratum)), F.lit(0)) if allocation else F.lit(0)
    by = Window.partitionBy(stratum).orderBy(shuffle_key(seed, key), key)
    ranked = df.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= max(allocation.values(), default=0))
    return ranked.where(F.col("_r") <= wanted).drop("_r")


def draw(df: DataFrame, n: int, key: str, stratum: str = "stratum", seed: int = SEED, oversample: dict[str, int] | None = None) -> DataFrame:
    return pick(df, allocate(sizes(df, stratum), n, oversample), key, stratum, seed)


def split(sample: DataFrame, key: str, share: float = 2 / 3, seed: int = SEED) -> DataFrame:
    """``split`` is dev for the first round(n * share) rows in seeded order, held-out for the others.

    The last of those rows is found by counts of the order's leading digits, then among the rows of one such
    prefix; the split itself is a comparison with it, without shuffle. Of rows with equal keys at the border, all
    are dev.
    """
    h = shuffle_key(seed + 1, key)
    counts = sample.groupBy(F.substring(h, 1, PREFIX).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # at most 16**PREFIX rows
    last = round(sum(r["n"] for r in counts) * share)
    before = list(accumulate((r["n"] for r in counts), initial=0))
    at = next((i for i, n in enumerate(before[1:]) if n >= last), None)
    if not last or at is None:
        return sample.withColumn("split", F.lit("held-out"))
    border = sample.where(F.substring(h, 1, PREFIX) == counts[at]["p"]).select(h.alias("h"), F.col(key).alias("k")).orderBy("h", "k").limit(last - before[at]).agg(F.max(F.struct("h", "k")).alias("m")).first()["m"]
    return sample.withColumn("split", F.when((h < border["h"]) | ((h == border["h"]) & (F.col(key) <= border["k"])), "dev").otherwise("held-out"))


def slice_power(sample: DataFrame, dimensions: list[str], assumed: float = 0.8) -> DataFrame:
    """dimension, value, n, margin at an assumed proportion, verdict."""
    long = sample.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("s")).select("s.*")
    counts = long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("margin", margin(F.bround(F.col("n") * assumed), F.col("n"))).withColumn("verdict", verdict(F.col("margin")))
