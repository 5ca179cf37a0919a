"""Small rules on points, sites and edges, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.operators.grid import finite

#: Metres a degree, the latitude beyond which a cell's width is no longer scaled, metres a foot, the
#: margin in metres of a decision on the vertical unit, points a valid crop has, metres a side of a crop.
DEGREE, MOST_LATITUDE, FOOT, UNIT_MARGIN, MIN_RETURNS, CROP = 111_320.0, 89.0, 0.3048, 5.0, 1000, 100


def upright(points: DataFrame, vertical: str) -> DataFrame:
    """``x, y, z`` with z upwards, of points whose ``vertical`` axis is z or y."""
    return points if vertical == "z" else points.withColumns({"y": F.col("z"), "z": F.col("y")})


def ground_only(points: DataFrame) -> DataFrame:
    return points.where(F.coalesce(F.col("is_ground"), F.lit(False)))


def cropped(points: DataFrame, x0: Column, y0: Column, size: float = CROP) -> DataFrame:
    """Points in the half-open box from ``x0, y0``, with coordinates from its corner."""
    x, y = F.col("x"), F.col("y")
    return points.where((x >= x0) & (x < x0 + size) & (y >= y0) & (y < y0 + size)).withColumns({"x": x - x0, "y": y - y0})


def crop_origins(extents: DataFrame, size: float = CROP) -> DataFrame:
    """``extents(x0, x1, y0, y1)`` with nine crops each, around the quarters of both sides: ``crop, ox, oy``, whole metres."""
    at = [(fx, fy) for fy in (0.25, 0.5, 0.75) for fx in (0.25, 0.5, 0.75)]
    corner = lambda c, f: F.floor(F.col(f"{c}0") + f * (F.col(f"{c}1") - F.col(f"{c}0")) - size / 2)
    crops = F.array(*(F.struct(F.lit(k).alias("crop"), corner("x", fx).alias("ox"), corner("y", fy).alias("oy")) for k, (fx, fy) in enumerate(at)))
    return extents.withColumn("c", F.explode(crops)).select(*extents.columns, "c.*")


def mask_class(height: Column, error: Column, edited: Column, edited_code: float = -32767.0) -> Column:
    """``void`` (edit mask 0 or no height), ``measured`` (mask 1 and a valid error), else ``edited``."""
    valid = finite(error) & (error >= 0) & (error != edited_code)
    return F.when((edited == 0) | ~finite(height), "void").when((edited == 1) & valid, "measured").otherwise("edited")


def producer_evidence(cells: DataFrame) -> DataFrame:
    """``cells(site, row, col, z, error, edited)`` with ``coverage`` and ``confidence``; voids are left out.

    A measured cell's support is less its height error, so that a smaller error is stronger; edited cells have no error
    estimate and take one constant, 0.
    """
    kind = mask_class(F.col("z"), F.col("error"), F.col("edited"))
    known = cells.withColumn("__kind", kind).where("__kind <> 'void'")
    measured = F.col("__kind") == "measured"
    return known.withColumns({"coverage": F.when(measured, "measured").otherwise("interpolated"), "confidence": F.when(measured, -F.col("error")).otherwise(0.0)}).drop("__kind")


def in_metres(points: DataFrame, references: DataFrame) -> DataFrame:
    """``points(site, z, ...)`` of sites whose vertical unit can be told, ``z`` in metres, with ``unit``; ``references(site, reference)`` are known heights."""
    middle = points.where(finite(F.col("z"))).groupBy("site").agg(F.percentile_approx("z", 0.5, 100_000).alias("__mid"))
    unit = middle.join(references, "site").select("site", vertical_unit(F.col("__mid"), F.col("reference")).alias("unit")).where("unit is not null")
    return points.join(F.broadcast(unit), "site").withColumn("z", F.when(F.col("unit") == "foot", F.col("z") * FOOT).otherwise(F.col("z")))


def vertical_unit(median: Column, reference: Column) -> Column:
    """``metre`` or ``foot``, whichever brings the median nearer to the reference height by the margin; else null."""
    dm, df = F.abs(median - reference), F.abs(median * FOOT - reference)
    return F.when(df - dm >= UNIT_MARGIN, "metre").when(dm - df >= UNIT_MARGIN, "foot")


def cell_metres(size_degrees: Column, latitude: Column) -> tuple[Column, Column]:
    """Metres of a geographic cell eastwards and northwards; without a latitude, the same both ways."""
    held = F.greatest(F.lit(-MOST_LATITUDE), F.least(F.lit(MOST_LATITUDE), latitude))
    scale = F.when(finite(latitude), F.cos(held * (math.pi / 180))).otherwise(1.0)
    return size_degrees * DEGREE * scale, size_degrees * DEGREE


def dishonest_cells(field: DataFrame) -> DataFrame:
    """``site, cells``: cells whose confidence is not within 0 to 100, or that are covered without a height. None if all are honest."""
    bad = ~finite(F.col("confidence")) | ~F.coalesce(F.col("confidence").between(0, 100), F.lit(False)) | (F.col("coverage").isNotNull() & ~finite(F.col("z")))
    return field.groupBy("site").agg(F.count_if(bad).alias("cells")).where("cells > 0")


def nominal_cell(area: Column, returns: Column) -> Column:
    """Cell size of the mean spacing of points, in whole metres, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(area / returns) - 1e-9))


def utm_zone(longitude: Column, latitude: Column) -> Column:
    """Code of the zone: 326xx north, 327xx south."""
    return F.when(latitude >= 0, 32600).otherwise(32700) + (F.floor((longitude + 180) / 6) % 60).cast("int") + 1


def eligible(vertices: DataFrame, least: int = 2) -> DataFrame:
    """Vertices of lines with at least so many."""
    lines = vertices.groupBy("line_id").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select("line_id")
    return vertices.join(lines, "line_id", "left_semi")
