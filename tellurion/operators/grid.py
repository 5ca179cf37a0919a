"""Points to cells, cell statistics, support and grades, as expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["site", "row", "col"]
#: Tolerance in cells of the outer boundary, half-count of the support rule, grade bounds,
#: factor from the median absolute deviation to a deviation, and deviations a robust mean keeps.
EDGE, HALF_COUNT, SOLID, DASHED, MAD_SCALE, MAD_WIDTH = 1e-6, 3, 66, 33, 1.4826, 3


def finite(*values: Column) -> Column:
    """Whether all are there, numbers, and not infinite."""
    ok = F.lit(True)
    for v in values:
        ok = ok & F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    return ok


def to_cells(points: DataFrame, cols: int = 100, rows: int = 100, size: float = 1.0) -> DataFrame:
    """Add ``row, col``; points outside by more than the tolerance go, others on the edge join the edge cell."""
    fx, fy = F.col("x") / size, F.col("y") / size
    inside = fx.between(-EDGE, cols + EDGE) & fy.between(-EDGE, rows + EDGE)

    def clamped(f: Column, n: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(f))).cast("int")

    return points.where(inside & finite(F.col("x"), F.col("y"), F.col("z"))).withColumns({"row": clamped(fy, rows), "col": clamped(fx, cols)})


#: How tools assign a point to a cell: rows from the south or the north, coordinates in steps, points on the outer
#: boundary kept, the grid's extent between the centres of its outer cells.
BINNING = {
    "floor": {},
    "north_up": {"north_up": True},
    "north_up_1mm_boundary": {"north_up": True, "step": 0.001, "boundary": True},
    "floor_centres": {"centres": True},
}


def binned(points: DataFrame, cols: int = 100, rows: int = 100, size: float = 1.0, **rule) -> DataFrame:
    """Points inside the grid by one rule of ``BINNING``, with ``row`` and ``col``. The plain rule is half open."""
    at = bin_of(cols, rows, size, **rule)
    return points.withColumn("__at", at).where(F.col("__at").isNotNull()).withColumns({"row": F.col("__at.row"), "col": F.col("__at.col")}).drop("__at")


def bin_of(cols: int, rows: int, size: float = 1.0, north_up: bool = False, step: float | None = None, boundary: bool = False, centres: bool = False) -> Column:
    """The ``row`` and ``col`` of a point by one rule of ``BINNING``; null outside of the grid."""
    x, y = (F.col(c) if step is None else F.rint(F.col(c) / step) * step for c in ("x", "y"))
    fx, fy = x / size, y / size
    col, row = F.floor(fx), (F.ceil(fy) - 1 if north_up else F.floor(fy))
    if boundary:
        on = fx.between(0, cols) & fy.between(0, rows)
        col = F.when(on, F.greatest(F.lit(0), F.least(F.lit(cols - 1), col))).otherwise(col)
        row = F.when(on, F.greatest(F.lit(0), F.least(F.lit(rows - 1), row))).otherwise(row)
    inside = finite(F.col("x"), F.col("y"), F.col("z"))
    if centres:
        inside = inside & fx.between(0.5, cols - 0.5) & fy.between(0.5, rows - 0.5)
    return F.when(inside & row.between(0, rows - 1) & col.between(0, cols - 1), F.struct(row.cast("int").alias("row"), col.cast("int").alias("col")))


def extents(points: DataFrame, size: float = 1.0, aligned: bool = False) -> DataFrame:
    """A site's grid from its finite points: ``x0, y0, cols, rows``; the origin is the least coordinate, or the multiple of ``size`` below it."""
    ok = points.where(finite(F.col("x"), F.col("y"), F.col("z")))
    ends = ok.groupBy("site").agg(*(f(c).alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))))
    origin = lambda c: F.floor(F.col(c) / size) * size if aligned else F.col(c)
    ends = ends.withColumns({"ox": origin("x0"), "oy": origin("y0")})
    count = lambda c, o: F.greatest(F.lit(1), F.floor((F.col(c) - F.col(o)) / size) + 1).cast("int")
    return ends.select("site", F.col("ox").cast("double").alias("x0"), F.col("oy").cast("double").alias("y0"), count("x1", "ox").alias("cols"), count("y1", "oy").alias("rows"))


def accounting(points: DataFrame, cols: int = 100, rows: int = 100, size: float = 1.0) -> DataFrame:
    """A site's points: all, not finite, outside of the grid, analysed, and cells filled, with what is to be warned of."""
    fx, fy = F.col("x") / size, F.col("y") / size
    ok = finite(F.col("x"), F.col("y"), F.col("z"))
    inside = ok & fx.between(-EDGE, cols + EDGE) & fy.between(-EDGE, rows + EDGE)
    cell = F.greatest(F.lit(0), F.least(F.lit(rows - 1), F.floor(fy))) * cols + F.greatest(F.lit(0), F.least(F.lit(cols - 1), F.floor(fx)))
    # By cell first, so that no site's cells are gathered as a set.
    per = points.withColumns({"ok": ok, "inside": inside}).groupBy("site", F.when(F.col("inside"), cell).alias("cell")).agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.count_if("inside").alias("inside"))
    out = per.groupBy("site").agg(F.sum("n").alias("source"), F.sum(F.col("n") - F.col("ok")).alias("skipped"), F.sum(F.col("ok") - F.col("inside")).alias("outside"), F.sum("inside").alias("analysed"), F.count("cell").alias("filled"))
    warn = F.array_compact(F.array(F.when(F.col("skipped") > 0, F.concat(F.col("skipped").cast("string"), F.lit(" not finite"))), F.when(F.col("outside") > 0, F.concat(F.col("outside").cast("string"), F.lit(" outside"))), F.when(F.col("filled") < cols * rows, F.concat((cols * rows - F.col("filled")).cast("string"), F.lit(" cells empty")))))
    return out.withColumn("warnings", F.array_join(warn, "; "))


def quantile_level(p: float) -> float:
    """A percentile's level in 0 to 1; one that is not finite is the median's."""
    return min(1.0, max(0.0, p)) if p == p and abs(p) != float("inf") else 0.5


def raster(cells: DataFrame, level: float = 0.9) -> DataFrame:
    """Count, mean, least, median and one percentile a cell."""
    return cells.groupBy(*CELL).agg(F.count("*").alias("n"), F.avg("z").alias("mean"), F.min("z").alias("least"), F.percentile("z", F.lit(0.5)).alias("median"), F.percentile("z", F.lit(quantile_level(level))).alias("p90"))


def despiked(cells: DataFrame, percent: float) -> DataFrame:
    """A cell's floor: its least height, or at ``percent`` above 0 (50 at most) the nearest rank, never the lowest of three or more."""
    if percent <= 0:
        return cells.groupBy(*CELL).agg(F.min("z").alias("floor"), F.count("*").alias("n"))
    sorted_ = cells.groupBy(*CELL).agg(F.array_sort(F.collect_list("z")).alias("zs"))  # the points of one cell
    n = F.size("zs")
    rank = F.greatest(F.ceil(min(percent, 50) / 100 * n).cast("int") - 1, F.when(n >= 3, 1).otherwise(0))
    return sorted_.select(*CELL, F.get("zs", F.least(n - 1, rank)).alias("floor"), n.cast("long").alias("n"))


def robust_raster(cells: DataFrame) -> DataFrame:
    """Mean of a cell's values within three scaled deviations of its median; of deviation 0, those equal to it."""
    whole = cells.groupBy(*CELL).agg(F.percentile("z", F.lit(0.5)).alias("mid"), F.collect_list("z").alias("zs"))  # the points of one cell
    off = F.array_sort(F.transform("zs", lambda z: F.abs(z - F.col("mid"))))
    n = F.size("off")
    middle = lambda k: F.get("off", k.cast("int"))
    # The median of the sorted deviations, as percentile interpolates it.
    mad = middle(F.floor((n - 1) / 2)) + (middle(F.floor(n / 2)) - middle(F.floor((n - 1) / 2))) * 0.5
    near = whole.withColumn("off", off).withColumn("kept", F.filter("zs", lambda z: F.abs(z - F.col("mid")) <= MAD_WIDTH * MAD_SCALE * mad))
    return near.select(*CELL, (F.aggregate("kept", F.lit(0.0), lambda a, z: a + z) / F.size("kept")).alias("robust"), F.size("kept").cast("long").alias("kept"))


def support(raster: DataFrame, target: float | None = None, shared: bool = False) -> DataFrame:
    """Add ``target``, the site's median count, and ``confidence`` (0 to 100) of measured cells.

    A ``target`` that is given holds for all sites, and a ``shared`` one is the median of all their cells.
    """
    if target is None:
        # By count first: the median of a site's cells from as many rows as there are different counts.
        by = [] if shared else ["site"]
        median = raster.groupBy(*by, "n").agg(F.count("*").alias("times")).groupBy(*by).agg(F.percentile("n", F.lit(0.5), F.col("times")).alias("target"))
        aimed = raster.join(F.broadcast(median), F.lit(True)) if shared else raster.join(median, "site")  # one row
    else:
        aimed = raster.withColumn("target", F.lit(float(target)))
    share = F.least(F.lit(1.0), F.col("n") / F.col("target")) * F.col("n") / (F.col("n") + HALF_COUNT)
    return aimed.withColumn("confidence", F.floor(100 * share + 0.5).cast("long"))


def grade(confidence: Column) -> Column:
    sound = finite(confidence)
    return F.when(sound & (confidence >= SOLID), "solid").when(sound & (confidence >= DASHED), "dashed").otherwise("gap")


def coarsened(supported: DataFrame, factor: int) -> DataFrame:
    """Blocks of ``factor`` cells a side: mean and least confidence, and cells with any."""
    block = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    return supported.groupBy("site", *block).agg(F.avg("confidence").alias("average"), F.min("confidence").alias("least"), F.count("*").alias("cells"))


def resampled(field: DataFrame, factor: int) -> DataFrame:
    """Coarse blocks of the support field and what each way of resampling says of them.

    ``field(site, row, col, coverage, confidence)`` has the supported cells. Of a block and band (measured ``m``,
    interpolated ``i``): ``near`` takes the value of one cell beside the block's centre, ``average`` and ``least``
    of the cells that carry the band; ``mode`` takes the commonest provenance, ties to the first by name.
    """
    m, i = (F.when(F.col("coverage") == c, F.col("confidence").cast("double")) for c in ("measured", "interpolated"))
    picked = (F.col("row") % factor == factor // 2 - 1) & (F.col("col") % factor == factor // 2)
    block = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    out = field.groupBy("site", *block).agg(
        F.count("*").alias("cells"),
        *(f(v).alias(f"{n}_{how}") for n, v in (("m", m), ("i", i)) for how, f in (("average", F.avg), ("least", F.min), ("count", F.count))),
        *(F.max(F.when(picked, v)).alias(f"{n}_near") for n, v in (("m", m), ("i", i))),
        F.max(F.when(picked, F.col("coverage"))).alias("near"),
    )
    return out.withColumns({"mode": F.when(F.col("i_count") >= F.col("m_count"), "interpolated").otherwise("measured"), "partial": F.col("cells") < factor * factor})
