"""Chords of simplified lines over cells and vertices without support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least share of a chord that lies in a cell's interior, and extent under which a chord runs along an axis.
LEAST, STRAIGHT = 1e-9, 1e-15


def clip(at: str, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """Where a chord is between two bounds along one axis, as shares of it, and whether it can be at all."""
    start, run = F.col(f"{at}1"), F.col(f"{at}2") - F.col(f"{at}1")
    flat = F.abs(run) < STRAIGHT
    a, b = F.try_divide(low - start, run), F.try_divide(high - start, run)
    return F.when(flat, 0.0).otherwise(F.least(a, b)), F.when(flat, 1.0).otherwise(F.greatest(a, b)), ~flat | ((start > low) & (start < high))


def passed_cells(chords: DataFrame, rows: int, cols: int, size: float = 1.0) -> DataFrame:
    """``chords(x1, y1, x2, y2, ...)`` once for each ``row, col`` of the grid whose interior it passes.

    A chord is followed row by row, so that it meets as many cells as it is long, not those of its bounding box.
    """
    bounds = lambda c, upto: (F.greatest(F.lit(0), F.floor(F.least(f"{c}1", f"{c}2") / size)), F.least(F.lit(upto - 1), F.floor(F.greatest(f"{c}1", f"{c}2") / size)))
    r0, r1 = bounds("y", rows)
    by_row = chords.withColumn("row", F.explode(F.when(r0 <= r1, F.sequence(r0, r1))))
    low, high, _ = clip("y", F.col("row") * size, (F.col("row") + 1) * size)
    ends = [F.col("x1") + F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)) * (F.col("x2") - F.col("x1")) for t in (low, high)]
    c0, c1 = bounds("x", cols)
    first, last = F.greatest(c0, F.floor(F.least(*ends) / size) - 1), F.least(c1, F.floor(F.greatest(*ends) / size) + 1)
    by_cell = by_row.withColumn("col", F.explode(F.when(first <= last, F.sequence(first, last))))
    across, along = (clip(c, F.col(at) * size, (F.col(at) + 1) * size) for c, at in (("x", "col"), ("y", "row")))
    share = F.least(F.lit(1.0), across[1], along[1]) - F.greatest(F.lit(0.0), across[0], along[0])
    return by_cell.where(across[2] & along[2] & (share > LEAST))


def over_cells(chords: DataFrame, cells: DataFrame, keys: list[str], rows: int, cols: int, size: float = 1.0) -> DataFrame:
    """``chords(site, keys, x1, y1, x2, y2, ...)`` with ``over``: whether each passes the interior of one of ``cells(site, row, col)``.

    Touching an edge or a corner isn't passing. ``keys`` name a chord in its site.
    """
    of = ["site", *keys]
    met = passed_cells(chords.select(*of, "x1", "y1", "x2", "y2"), rows, cols, size).join(cells.select("site", "row", "col").distinct(), ["site", "row", "col"], "left_semi")
    return chords.join(met.select(*of).distinct().withColumn("over", F.lit(True)), of, "left").withColumn("over", F.coalesce("over", F.lit(False)))


def chords_of(kept: DataFrame, line: list[str], *more: str) -> DataFrame:
    """Chords between neighbours of the vertices ``kept(line, seq, x, y)`` of a line: ``seq, seq2, x1, y1, x2, y2``, and of ``more`` columns both ends' values."""
    order = Window.partitionBy(*line).orderBy("seq")
    after = {f"{c}2": F.lead(c).over(order) for c in ("seq", "x", "y", *more)}
    return kept.withColumns(after).where(F.col("seq2").isNotNull()).withColumnsRenamed({"x": "x1", "y": "y1"})


def bridges(vertices: DataFrame, line: list[str], keep: str, gap: Column, *stretch: str) -> DataFrame:
    """Chords of the vertices with ``keep``, and ``bridge``: whether a vertex with ``gap`` lies between the ends of one.

    Only vertices of one ``stretch`` of a line are joined by a chord.
    """
    upto = F.sum(F.when(gap, 1).otherwise(0)).over(Window.partitionBy(*line).orderBy("seq"))
    marked = vertices.withColumns({"__gaps": upto, "__at": F.when(gap, 1).otherwise(0)}).where(F.col(keep))
    return chords_of(marked, [*line, *stretch], "__gaps", "__at").withColumn("bridge", F.col("__gaps2") - F.col("__at2") > F.col("__gaps")).drop("__gaps", "__gaps2", "__at", "__at2")
