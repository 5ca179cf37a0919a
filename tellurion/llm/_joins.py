"""Joins and components that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.llm._util import cut, free

SALTS = 64
#: Keys that ``counted_join`` broadcasts at most.
HOT = 10_000
#: A component's label reaches all its nodes in about the logarithm of its diameter; this bound is far beyond.
MAX_ROUNDS = 60


def spread_join(left: DataFrame, right: DataFrame, key: str, salts: int = SALTS, how: str = "inner") -> DataFrame:
    """Join ``left`` with ``right``, whose ``key`` is unique, by key and salt.

    Every key of ``left`` lies in at most ``salts`` tasks, so a hot key is no single task's work, and a row of
    ``right`` is copied only as often as its key has salts in use: once for a key of one row. ``left`` is read
    twice and should be materialised.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    used = salted.groupBy(key, "_salt").agg(F.lit(1).alias("_one")).drop("_one")
    return salted.join(used.join(right, key), [key, "_salt"], how).drop("_salt")


def counted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``left`` with ``right(key, n, ...)``, whose ``key`` is unique and where ``n`` counts the rows of ``left``.

    Keys that hold more than one in ``HOT`` of these rows are at most ``HOT``: they are broadcast and meet their rows
    where these lie. The rows of all other keys are shuffled, once. Both sides are read twice and should be
    materialised.
    """
    total = right.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(right.where(F.col("n") * HOT > total))  # at most HOT rows
    rest = left.join(F.broadcast(right.where(F.col("n") * HOT > total).select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(right.where(F.col("n") * HOT <= total), key, how)).drop("n")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``edges(a, b)``: the smallest node reachable.

    Each round takes the least label over a node's links and then the label of that label. Labels live in the
    shared folder, each round's in place of the last's; only whether any changed reaches the driver.
    """
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component")))
    for _ in range(MAX_ROUNDS):
        said = spread_join(both, labels.select(F.col("node").alias("u"), "component"), "u").groupBy(F.col("v").alias("node")).agg(F.min("component").alias("near"))
        step = cut(labels.join(said, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("far"))
        moved = cut(spread_join(step, jump, "component").select("node", "old", F.least("component", "far").alias("component")))
        free(labels, step)
        labels = moved
        if moved.where(F.col("old") != F.col("component")).isEmpty():
            free(both)
            named = labels.select("node", "component")
            named.cut_path = labels.cut_path
            return named
    raise RuntimeError("components did not settle")
