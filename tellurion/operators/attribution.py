"""Where lines of other tools come from: the block of cells behind a segment, the cells at its middle, polygons around points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.operators.contours import blocks

#: How far an end may be outside of its block in cells, and a level outside of its block's heights.
EDGE, BRACKET = 1e-9, 1e-6


def source_blocks(segments: DataFrame, cells: DataFrame, keys: list[str], size: float = 1.0) -> DataFrame:
    """``segments(site, keys, x1, y1, x2, y2, confidence)`` with the block that each comes from, told by where it lies alone.

    Candidates are blocks of ``cells(site, row, col, coverage, confidence)`` that hold both ends. Those with the segment's
    confidence go first, then that whose centre is nearest to its middle, then the lowest row and column. ``block_row,
    block_col, block_confidence, block_prov`` are the block's, ``candidates`` how many there were, ``alike`` whether the confidence
    agrees. A segment in no block has nulls and no candidates.
    """
    slack = max(1e-9, size * EDGE)
    first = lambda c: F.ceil((F.greatest(f"{c}1", f"{c}2") - slack) / size - 1.5)
    last = lambda c: F.floor((F.least(f"{c}1", f"{c}2") + slack) / size - 0.5)
    steps = lambda c: F.when(first(c) <= last(c), F.sequence(first(c), last(c)))
    of = ["site", *keys]
    tried = segments.select(*of, "x1", "y1", "x2", "y2", "confidence").withColumn("row", F.explode(steps("y"))).withColumn("col", F.explode(steps("x")))
    known = blocks(cells, "confidence", "coverage")
    least = F.least(*(F.col(f"confidence{k}") for k in range(4)))
    any_of = lambda kind: F.greatest(*((F.col(f"coverage{k}") == kind) for k in range(4)))
    prov = F.when(any_of("measured") & any_of("interpolated"), "X").when(any_of("measured"), "M").otherwise("I")
    found = tried.join(known.select("site", "row", "col", least.alias("block_confidence"), prov.alias("block_prov")), ["site", "row", "col"])
    off = lambda c, at: F.pow((F.col(f"{c}1") + F.col(f"{c}2")) / 2 - (F.col(at) + 1) * size, 2)
    rank = F.struct((F.col("block_confidence") != F.col("confidence")).alias("other"), (off("x", "col") + off("y", "row")).alias("off"), F.col("row").alias("block_row"), F.col("col").alias("block_col"), "block_confidence", "block_prov")
    best = found.groupBy(*of).agg(F.min(rank).alias("b"), F.count("*").alias("candidates"))
    picked = best.select(*of, "b.block_row", "b.block_col", "b.block_confidence", "b.block_prov", "candidates", (~F.col("b.other")).alias("alike"))
    return segments.join(picked, of, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def middle(c: str) -> Column:
    return (F.col(f"{c}1") + F.col(f"{c}2")) / 2


def cell_evidence(segments: DataFrame, cells: DataFrame, size: float = 1.0) -> DataFrame:
    """``segments`` with the evidence of the cell at their middle, ``cell_m``: its count, or ``cell_i``: less its distance to data.

    ``cells(site, row, col, n, dist)`` has ``n`` 0 or null where nothing was measured. Beside the grid both are null.
    """
    have = F.coalesce("n", F.lit(0)) > 0
    known = cells.select("site", F.col("row").alias("__row"), F.col("col").alias("__col"), F.when(have, F.col("n")).alias("cell_m"), F.when(~have, -F.col("dist") * size).alias("cell_i"))
    at = {"__row": F.floor(middle("y") / size).cast("int"), "__col": F.floor(middle("x") / size).cast("int")}
    return segments.withColumns(at).join(known, ["site", "__row", "__col"], "left").drop("__row", "__col")


def block_evidence(segments: DataFrame, cells: DataFrame, rows: int, cols: int, size: float = 1.0) -> DataFrame:
    """``segments(site, level, ...)`` with the evidence of the four cells around their middle (at the grid's edge, the last four).

    ``block_m`` is the least count of the measured ones, ``block_i`` less the greatest distance to data of the others, and
    ``bracketed`` says whether the level lies between their heights.
    """
    clamp = lambda c, upto: F.greatest(F.lit(0), F.least(F.lit(upto - 2), F.floor(middle(c) / size - 0.5))).cast("int")
    known = blocks(cells.withColumn("n", F.coalesce("n", F.lit(0))), "n", "dist", "z")
    have = [F.col(f"n{k}") > 0 for k in range(4)]
    m = F.least(*(F.when(h, F.col(f"n{k}")) for k, h in enumerate(have)))
    i = F.greatest(*(F.when(~h, F.col(f"dist{k}") * size) for k, h in enumerate(have)))
    z = [F.col(f"z{k}") for k in range(4)]
    known = known.select("site", F.col("row").alias("__row"), F.col("col").alias("__col"), m.alias("block_m"), (-i).alias("block_i"), F.least(*z).alias("__low"), F.greatest(*z).alias("__high"))
    met = segments.withColumns({"__row": clamp("y", rows), "__col": clamp("x", cols)}).join(known, ["site", "__row", "__col"], "left")
    return met.withColumn("bracketed", F.col("level").between(F.col("__low") - BRACKET, F.col("__high") + BRACKET)).drop("__row", "__col", "__low", "__high")


def inside(points: DataFrame, edges: DataFrame, unit: list[str], polygon: list[str], key: list[str], height: float = 1.0) -> DataFrame:
    """``unit, polygon, key`` of the points inside a polygon of their unit: those whose ray to the right crosses its edges an odd number of times.

    ``edges(unit, polygon, x1, y1, x2, y2)`` are those of all rings of all parts, so holes and islands count by themselves. Points
    ``points(unit, key, x, y)`` and edges meet by bands of ``height``. An edge holds its lower end and not its upper one, so a ray through a vertex counts once or twice as it should. Edges
    that lie level, and nulls, cross nothing.
    """
    band = lambda y: F.floor(y / height)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edges.select(*unit, *polygon, "x1", "y1", "x2", "y2").where(F.col("y1") != F.col("y2")).withColumn("__band", F.explode(F.sequence(band(low), band(high))))
    p = points.select(*unit, *key, "x", "y").withColumn("__band", band(F.col("y")))
    spans = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    crossing = F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    met = p.join(e, [*unit, "__band"]).where(spans & crossing)
    return met.groupBy(*unit, *polygon, *key).agg((F.count("*") % 2).alias("__odd")).where("__odd = 1").drop("__odd")
