"""Contour segments of a sparse grid: blocks of four cells, crossings a level, evidence from the block."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Corners of a block as (row, col) offsets, counter-clockwise, and its edges as pairs of corners.
CORNERS = ((0, 0), (0, 1), (1, 1), (1, 0))
EDGES = ((0, 1), (1, 2), (3, 2), (0, 3))
#: Slack of a level in intervals, and the twist under which a block has no saddle point.
SLACK, FLAT = 1e-9, 1e-12


def blocks(cells: DataFrame, *values: str) -> DataFrame:
    """Blocks ``site, row, col`` whose four cells are all there, with each value's corners ``<value>0..3``.

    A cell is sent to the up to four blocks it is a corner of, so one shuffle by block assembles them.
    """
    roles = F.array(*(F.struct((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.lit(k).alias("corner")) for k, (dr, dc) in enumerate(CORNERS)))
    sent = cells.select("site", F.explode(roles).alias("of"), *values).select("site", "of.*", *values)
    at = [F.max(F.when(F.col("corner") == k, F.col(v))).alias(f"{v}{k}") for v in values for k in range(4)]
    return sent.groupBy("site", "row", "col").agg(F.count("*").alias("corners"), *at).where("corners = 4").drop("corners")


def crossing(edge: tuple[int, int], k: int) -> Column:
    """Where the level crosses an edge, in cells, and whether it does; cell centres lie at half cells."""
    a, b = edge
    (ra, ca), (rb, cb) = CORNERS[a], CORNERS[b]
    za, zb, level = F.col(f"z{a}"), F.col(f"z{b}"), F.col("level")
    along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(level - za, zb - za)))
    x, y = F.col("col") + 0.5 + ca + along * (cb - ca), F.col("row") + 0.5 + ra + along * (rb - ra)
    return F.struct(F.lit(k).alias("edge"), x.alias("x"), y.alias("y"), ((za >= level) != (zb >= level)).alias("hit"))


def segments(cells: DataFrame, interval: float = 1.0, parts: bool = False, given: list[float] | None = None) -> DataFrame:
    """``site, level, row, col, x1, y1, x2, y2, confidence`` of ``cells(site, row, col, z, confidence)``.

    Levels are the multiples of ``interval``, or those ``given`` (as by ``level_list``); a block meets only those between its own least and greatest
    height. A height at the level counts as above it. In a saddle the value at the bilinear saddle point
    decides which corners are joined, their mean where there is no such point. A segment's confidence is the
    least of its block's. Cells with ``coverage`` (measured or interpolated) give segments ``prov`` (M, I, or X of
    both) and the least confidence of the corners of either kind, ``m`` and ``i``.
    With ``parts``, column ``part`` numbers the segments of a block and level.
    """
    typed = "coverage" in cells.columns
    z, conf = [F.col(f"z{k}") for k in range(4)], [F.col(f"confidence{k}") for k in range(4)]
    # A level that rounding puts a little above a block's greatest height still meets it.
    first, last = F.floor(F.least(*z) / interval - SLACK).cast("long") + 1, F.floor(F.greatest(*z) / interval + SLACK).cast("long")
    levels = F.sequence(first, last)
    met = blocks(cells, "z", "confidence", *(["coverage"] if typed else []))
    if given is None:
        met = met.where(last >= first).withColumn("level", F.explode(levels)).withColumn("level", F.col("level") * F.lit(interval))
    else:
        listed = F.array(*(F.lit(float(x)) for x in given)) if given else F.array().cast("array<double>")
        met = met.withColumn("level", F.explode(F.filter(listed, lambda x: (x > F.least(*z)) & (x <= F.greatest(*z)))))
    twist = z[0] + z[2] - z[1] - z[3]
    saddle = F.when(F.abs(twist) >= FLAT, F.try_divide(z[0] * z[2] - z[1] * z[3], twist)).otherwise((z[0] + z[1] + z[2] + z[3]) / 4)
    joined = (saddle >= F.col("level")) == (z[0] >= F.col("level"))
    met = met.withColumn("e", F.filter(F.array(*(crossing(e, k) for k, e in enumerate(EDGES))), lambda e: e["hit"]))

    def pair(i: int, j: int) -> Column:
        return F.struct(F.get("e", F.lit(i)).alias("p"), F.get("e", F.lit(j)).alias("q"))

    pairs = F.when(F.size("e") == 2, F.array(pair(0, 1))).when(joined, F.array(pair(0, 1), pair(2, 3))).otherwise(F.array(pair(0, 3), pair(1, 2)))
    kind = lambda name: F.least(*(F.when(F.col(f"coverage{k}") == name, conf[k]) for k in range(4)))
    both = [kind("measured").alias("m"), kind("interpolated").alias("i")] if typed else []
    out = met.select("site", "level", "row", "col", F.least(*conf).alias("confidence"), *both, F.posexplode(pairs).alias("part", "s"))
    extra = [F.when(F.col("i").isNull(), "M").when(F.col("m").isNull(), "I").otherwise("X").alias("prov"), "m", "i"] if typed else []
    out = out.select("site", "level", "row", "col", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"), "confidence", *extra, *(["part"] if parts else []))
    return out.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def uniform(levels: list[float]) -> float | None:
    """The spacing of the levels if it is the same throughout."""
    steps = [b - a for a, b in zip(levels, levels[1:], strict=False)]
    return steps[0] if steps and all(abs(s - steps[0]) <= SLACK * max(1.0, abs(steps[0])) for s in steps) else None


def no_contours(cells: DataFrame, levels: list[float]) -> DataFrame:
    """``site, reason`` of sites whose surface ``cells(site, row, col, z)`` no level crosses: too few covered cells (in fewer than two rows or
    columns, too), no levels, a flat surface, a range between two levels, or no block of cells that a level crosses."""
    heights = cells.where(F.col("z").isNotNull() & ~F.isnan("z") & (F.abs("z") < float("inf")))
    ends = heights.groupBy("site").agg(F.min("z").alias("low"), F.max("z").alias("high"), (F.max("row") > F.min("row")).alias("tall"), (F.max("col") > F.min("col")).alias("wide"))
    listed = F.array(*(F.lit(float(x)) for x in levels)) if levels else F.array().cast("array<double>")
    z = [F.col(f"z{k}") for k in range(4)]
    crossed = blocks(heights, "z").where(F.exists(listed, lambda x: (x > F.least(*z)) & (x <= F.greatest(*z)))).select("site").distinct().withColumn("crossed", F.lit(True))
    sites = cells.select("site").distinct().join(ends, "site", "left").join(crossed, "site", "left").where("crossed is null")
    few = F.col("low").isNull() | ~F.col("tall") | ~F.col("wide")
    between = ~F.exists(listed, lambda x: (x > F.col("low")) & (x < F.col("high")))
    reason = F.when(few, "too few covered cells").when(F.size(listed) == 0, "no levels").when(F.col("low") == F.col("high"), "flat surface").when(between, "range between levels").otherwise("no cell crosses a level")
    return sites.select("site", reason.alias("reason"))


def level_list(interval: float | None = None, low: float | None = None, high: float | None = None, given: list[float] | None = None, most: int = 200) -> tuple[list[float], float | None]:
    """The levels of a range or those given, and their spacing (null unless uniform).

    Of more than ``most``, every k-th is kept, and the highest in place of the last, so that the whole range stays.
    """
    if given is None:
        first = math.ceil(low / interval) * interval
        levels = [first + k * interval for k in range(max(0, math.floor((high - first) / interval + 1 + SLACK)))]
    else:
        levels = sorted(given)
    spacing = interval if given is None else uniform(levels)
    if len(levels) <= most:
        return levels, spacing
    k = -(-len(levels) // most)
    thinned = levels[::k]
    thinned[-1] = levels[-1]
    return thinned, k * interval if given is None else uniform(thinned)


def feature_runs(vertices: DataFrame, grade) -> DataFrame:
    """Edges of ``vertices(line_id, seq, x, y, confidence)`` with ``grade``, that of the lesser end, and ``run``, the
    number of the stretch of one grade in the line. A vertex between two stretches ends one and starts the other."""
    order = Window.partitionBy("line_id").orderBy("seq")
    after = {f"{c}2": F.lead(c).over(order) for c in ("x", "y", "confidence")}
    e = vertices.withColumns(after).where(F.col("x2").isNotNull()).withColumn("grade", grade(F.least("confidence", "confidence2")))
    starts = F.when(F.col("grade") == F.lag("grade").over(order), 0).otherwise(1)
    e = e.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order))
    return e.select("line_id", "seq", "run", "grade", "x", "y", "x2", "y2")


def anchored_rings(vertices: DataFrame) -> DataFrame:
    """Closed rings ``line_id, seq, x, y`` turned to start at their least (x, y), which is repeated at the end."""
    first = vertices.groupBy("line_id").agg(F.min(F.struct("x", "y", "seq")).alias("a"), F.count("*").alias("n"))
    turned = vertices.join(first, "line_id").withColumn("seq", F.pmod(F.col("seq") - F.col("a.seq"), F.col("n")))
    again = turned.where("seq = 0").withColumn("seq", F.col("n"))
    return turned.unionByName(again).drop("a", "n")
