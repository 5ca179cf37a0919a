"""Mixing sources to target weights by entropy balancing.

Rates ``r`` of the documents minimise the divergence ``sum(r log r - r + 1)`` from one copy each under one
constraint a source, ``sum(r * size) = target``, and the bound ``r <= most``. The dual is convex; its solution
tilts each document exponentially, ``r = min(most, exp(lambda * size / scale))``. Newton's method finds every
source's multiplier at once, each step one aggregation over the (source, size) histogram, kept inside a
bracket that always holds the root. Rates are then rounded into whole copies against hashed uniforms, with
one threshold a source placed so that the words taken meet the target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellurion.llm._util import WORD, apart, cut, free, join_small, table

MOST = 3.0
BINS = 4096
TOLERANCE, MAX_STEPS = 1e-7, 60


def sized() -> Column:
    """The words of ``text`` (null: 0)."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(histogram: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Per source: ``source_size``, ``target`` and what the solver needs. The windows see one row a source."""
    per = histogram.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")).alias("square"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int")))
    whole = Window.partitionBy()
    # A capped source never comes free again as the level only rises: the capped ones lead in order of cap / weight.
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("cap", most * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))))
        .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"])
    )
    return per.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"), F.try_divide(F.col("square"), F.col("source_size")).alias("scale"), "least")


def tilted(most: float) -> Column:
    return F.least(F.lit(most), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(math.log(most)))))


def solve(histogram: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """Add each source's multiplier ``lam``; the state stays in a table, only the largest error is fetched."""
    share = F.try_divide(F.col("target"), F.col("source_size"))
    state = cut(
        sources.withColumn("lam", F.lit(0.0))
        .withColumn("low", F.least(F.lit(0.0), F.log(share) * F.col("scale") / F.col("least")))
        .withColumn("high", F.when(share > 1, F.log(F.lit(most)) * F.col("scale") / F.col("least")).otherwise(0.0))
    )
    for _ in range(MAX_STEPS):
        before = state
        rate = tilted(most)
        moved = join_small(histogram, state.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
            F.sum(F.when(rate < most, F.col("n") * F.col("size") * F.col("size") / F.col("scale") * rate).otherwise(0.0)).alias("slope"),
        )
        error = F.col("got") - F.col("target")
        newton = F.col("lam") - error / F.nullif(F.col("slope"), F.lit(0.0))
        state = state.join(moved.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").withColumn("low", F.when(error < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(error > 0, F.col("lam")).otherwise(F.col("high")))
        inside = (newton >= F.col("low")) & (newton <= F.col("high"))
        state = cut(
            state.withColumn("off", F.abs(error) / F.nullif(F.col("target"), F.lit(0.0)))
            .withColumn("lam", F.when(F.col("off") <= TOLERANCE, F.col("lam")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2))
            .select("source", "source_size", "target", "scale", "least", "lam", "low", "high", "off")
        )
        free(before)
        if (state.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            return state.select("source", "source_size", "target", "scale", "lam")
    raise RuntimeError(f"no multipliers within {TOLERANCE} of the targets after {MAX_STEPS} steps")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST) -> DataFrame:
    """``docs`` with ``size, source_size, target, rate, copies``: how often the mix takes each document.

    Sources in code point order, null last, weigh ``weights``, repeating, and share all words; a target stops
    at ``most`` times its source's words and the excess is shared again. Copies are whole and at most
    ``most``. Reruns agree: the rounding hashes ``doc_id`` and ``size``. A document without words gets rate 1
    and one copy of nothing; a source without words has target 0; rows that repeat are documents of their
    own; an empty table gives no rows. Columns of these five names in ``docs`` (in any case) are replaced.
    """
    row, given = apart(docs, "size", "source_size", "target", "rate", "copies")
    docs = docs.select(row, "doc_id", "source", sized().alias("size"))
    sizes = cut(docs.select("doc_id", "source", "size"))
    histogram = cut(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    state = solve(histogram, cut(source_targets(histogram, weights, most)), most).withColumnRenamed("source", "of")

    def rated(x: DataFrame) -> DataFrame:
        x = join_small(x, state, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", F.when(F.col("size") > 0, tilted(most)).otherwise(1.0))
        # Below 0 where plain rounding by the uniform would take one more copy; whole rates are past all limits.
        lead = F.pmod(F.xxhash64("doc_id", "size"), F.lit(1 << 30)) / float(1 << 30) - (F.col("rate") - F.floor("rate"))
        return x.withColumn("bin", F.when((F.col("rate") < most) & (F.col("size") > 0), F.floor(lead * BINS)).otherwise(BINS))

    def copied(x: DataFrame) -> DataFrame:
        x = join_small(x, limits, F.col("source").eqNullSafe(F.col("at")))
        return x.withColumn("copies", (F.floor("rate") + F.when(F.col("bin") <= F.col("limit"), 1).otherwise(0)).cast("long"))

    bins = rated(sizes).groupBy("source", "bin", "target").agg(F.sum(F.floor("rate") * F.col("size")).alias("base"), F.sum("size").alias("more"))
    per, upto = Window.partitionBy("source"), Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("left", F.col("target") - F.sum("base").over(per)).withColumn("extra", F.sum("more").over(upto))
    none = bins.select("source", F.lit(-2 * BINS).cast("long").alias("bin"), F.col("left").alias("missed"))
    best = bins.where(F.col("bin") < BINS).select("source", "bin", (F.col("left") - F.col("extra")).alias("missed")).unionByName(none)
    limits = cut(best.groupBy("source").agg(F.min(F.struct(F.abs("missed").alias("by"), F.col("bin").alias("limit"), "missed")).alias("x"))).select(F.col("source").alias("at"), "x.limit", "x.missed")
    # One document a source gains or loses a copy where that brings the words taken nearer still.
    change = F.when(F.col("bin") <= F.col("limit"), -F.col("size")).otherwise(F.col("size"))
    off = F.abs(F.col("missed") - change)
    turned = copied(rated(sizes)).where((F.col("bin") < BINS) & (off < F.abs("missed"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), F.col("doc_id").alias("turned"), F.signum(change).cast("long").alias("by"))).alias("x"))
    turned = cut(turned.select(F.col("source").alias("for"), "x.turned", "x.by"))
    out = join_small(copied(rated(docs)), turned, F.col("source").eqNullSafe(F.col("for")) & (F.col("doc_id") == F.col("turned")), "left")
    out = out.withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0)))
    return out.select(*given, "size", "source_size", "target", "rate", "copies")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
