"""Bootstraps over whole units: exact draws of a sequential generator from any place, and weights that merge.

The generator's step is linear in the bits of its state, so that the state after k steps is a product of matrices, one for
each bit of k. Every replicate and block of draws starts where a sequential run would be; nothing waits for draws before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.operators.statistics import dealt, numbered, parts, rank_correlation, running
from tellurion.sources.shared import written

#: Draws that one row of work makes, and rows of work that are taken together.
BLOCK, TOGETHER = 4096, 64
U32 = np.uint32


def stepped(s: np.ndarray) -> np.ndarray:
    """The states after one step of xorshift32 (shifts 13, 17 and 5)."""
    s = s ^ (s << U32(13))
    s = s ^ (s >> U32(17))
    return s ^ (s << U32(5))


@lru_cache(1)
def matrices() -> list[np.ndarray]:
    """Images of the 32 single bits after 2**b steps, for b from 0 on."""
    out = [stepped(U32(1) << np.arange(32, dtype=U32))]
    while len(out) < 48:
        out.append(applied(out[-1], out[-1]))
    return out


def applied(matrix: np.ndarray, s: np.ndarray) -> np.ndarray:
    out = np.zeros_like(s)
    for bit in range(32):
        out ^= np.where((s >> U32(bit)) & U32(1), matrix[bit], U32(0))
    return out


def advanced(seed: int, k: np.ndarray) -> np.ndarray:
    """The generator's states ``k`` steps after the seed."""
    s = np.full(len(k), seed & 0xFFFFFFFF, U32)
    for bit, m in enumerate(matrices()):
        on = (k >> bit) & 1 == 1
        if on.any():
            s[on] = applied(m, s[on])
    return s


def draws(spark: SparkSession, seed: int, units: int, replicates: int) -> DataFrame:
    """``replicate, number, times``: how often each of ``units`` units (from 0) is drawn in as many draws with replacement.

    Draw j of replicate r is the ``r * units + j``-th of the generator, one run for all.
    """
    blocks = -(-units // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy()
            for at in range(0, len(every), TOGETHER):
                r, block = np.divmod(every[at : at + TOGETHER], blocks)
                first = block * BLOCK
                s, left = advanced(seed, r * units + first), np.minimum(units - first, BLOCK)
                keys = []
                for j in range(int(left.max())):
                    s = stepped(s)
                    on = left > j
                    keys.append(r[on] * units + np.floor(s[on] / 4294967296.0 * units).astype(np.int64))
                key, times = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((key // units).astype(np.int32)), pa.array(key % units), pa.array(times)], names=["replicate", "number", "times"])

    tasks = parts(units, replicates)
    rows = spark.range(0, replicates * blocks, 1, tasks).mapInArrow(run, "replicate int, number long, times long")
    # Dealt by number, as the units are, so that counting needs no more than a task's own draws and joining no other exchange.
    return rows.repartition(tasks, "number").groupBy("replicate", "number").agg(F.sum("times").alias("times"))


def replicated(units: DataFrame, key: str, seed: int, replicates: int) -> DataFrame:
    """``units`` once for each replicate that draws them, with ``replicate`` and ``times``. ``key`` is a unique integer; units are numbered as by ``numbered``."""
    placed = written(numbered(units, key))
    n = placed.count()
    return dealt(draws(units.sparkSession, seed, n, replicates), placed, n, replicates) if n else placed.select(F.lit(0).alias("replicate"), F.lit(0).cast("long").alias("times"), *units.columns)


def ratios(units: DataFrame, key: str, measures: dict[str, tuple[str, str, float]], seed: int, replicates: int) -> DataFrame:
    """``replicate`` and a column a measure ``(top, bottom, scale)``: the scaled ratio of their sums, all of the same draws, so that they can be compared pair by pair."""
    total = lambda c: F.sum(F.col("times") * F.col(c))
    return replicated(units, key, seed, replicates).groupBy("replicate").agg(*(F.try_divide(F.lit(scale) * total(top), total(bottom)).alias(name) for name, (top, bottom, scale) in measures.items()))


def means(units: DataFrame, key: str, value: str, seed: int, replicates: int) -> DataFrame:
    """``replicate, mean``: the mean of the drawn units' values."""
    return means_of(replicated(units.select(key, value), key, seed, replicates), value)


def means_of(drawn: DataFrame, value: str) -> DataFrame:
    return drawn.groupBy("replicate").agg((F.sum(F.col("times") * F.col(value)) / F.sum("times")).alias("mean"))


def correlations(units: DataFrame, key: str, a: str, b: str, seed: int, replicates: int) -> DataFrame:
    """``replicate, n, rho``: Spearman's coefficient over the drawn units, each as often as it was drawn."""
    return rank_correlation(pairs(units, key, a, b, seed, replicates), "replicate", a, b, weight="times")


def pairs(units: DataFrame, key: str, a: str, b: str, seed: int, replicates: int) -> DataFrame:
    """``replicate, a, b, times``: how often units with these values were drawn. Written, since what ranks them reads them time and again."""
    drawn = replicated(units.select(key, a, b), key, seed, replicates)
    return written(drawn.groupBy("replicate", a, b).agg(F.sum("times").alias("times")))


def middle_of(values: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """``by, median`` of values that count ``weight`` (whole) times: the middle one, or the mean of the middle two."""
    counts = values.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(by, value).agg(F.sum(weight).alias("w"))
    total = counts.groupBy(by).agg(F.sum("w").alias("total"))
    upper = F.floor(F.col("total") / 2)
    lower = F.when(F.col("total") % 2 == 1, upper).otherwise(upper - 1)
    reach = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))
    return running(counts, by, value, "w").join(total, by).groupBy(by).agg(((reach(lower) + reach(upper)) / 2).alias("median"))


def shares_above(units: DataFrame, key: str, kept: DataFrame, other: DataFrame, value: str, seed: int, replicates: int) -> DataFrame:
    """``replicate, median, share``: the median of the drawn units' ``kept(key, value)``, and the percentage of their ``other(key, value)`` above it."""
    drawn = replicated(units.select(key), key, seed, replicates)
    # By value first: a value of a unit is as many rows as there are units that have it.
    repeated = lambda t: drawn.join(t.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n")), key).groupBy("replicate", value).agg(F.sum(F.col("times") * F.col("n")).alias("w"))
    medians = middle_of(repeated(kept), "replicate", value, "w")
    met = repeated(other).join(medians, "replicate")
    return met.groupBy("replicate").agg(F.first("median").alias("median"), (100 * F.sum(F.when(F.col(value) > F.col("median"), F.col("w")).otherwise(0)) / F.sum("w")).alias("share"))


def interval(replicates: DataFrame, *values: str, level: float = 0.95) -> list[Column]:
    """Aggregates: the bounds of the middle ``level`` of each value's replicates, linearly interpolated. One row a replicate is little."""
    tail = (1 - level) / 2
    return [F.percentile(v, F.lit(q)).alias(f"{v}_{name}") for v in values for name, q in (("low", tail), ("high", 1 - tail))]


# -- weights that merge ------------------------------------------------------------------------------------------

#: How likely a Poisson variable of mean 1 is at most 0, 1, 2, ...
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def poisson_weights(keys: np.ndarray, seed: int, replicates: int) -> np.ndarray:
    """A Poisson weight of mean 1 for each key (a row) and replicate, from their hash alone."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(replicates, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0xC2B2AE3D27D4EB4F)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        x ^= x >> np.uint64(31)
    return np.searchsorted(POISSON, (x >> np.uint64(11)) / float(1 << 53), side="right")


def merged_sums(units: DataFrame, key: str, columns: list[str], seed: int, replicates: int) -> DataFrame:
    """``replicate`` and the sums of ``columns`` over units weighted at random: one pass, a row a task and replicate is shuffled.

    A unit's weights come from its key, so that sums of parts of the units add up to those of all, and no unit has to be counted
    or numbered. Where units are very many, this stands in for draws with replacement.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(columns), replicates))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                w = poisson_weights(part.column(0).to_numpy(), seed, replicates)
                for k in range(len(columns)):
                    sums[k] += part.column(k + 1).to_numpy() @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), *(pa.array(s) for s in sums)], names=["replicate", *columns])

    given = units.select(F.col(key).cast("long").alias(key), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    return given.mapInArrow(run, "replicate int, " + ", ".join(f"`{c}` double" for c in columns)).groupBy("replicate").agg(*(F.sum(c).alias(c) for c in columns))
