"""The support field: heights of empty cells, their distance to data, slope and support, tile by tile.

Measured cells are sent to every tile that they lie in or near, so that a tile's task holds the tile and its margin,
and nothing depends on how the grid is tiled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.operators.grid import HALF_COUNT

#: Cells a side of a tile.
TILE = 64
SCHEMA = "site string, row int, col int, n long, z double, coverage string, dist int, slope double, directions int, aside boolean"


def measured_support(n: Column, target: Column, half: float = HALF_COUNT) -> Column:
    """Support of a measured cell in 0 to 1: relative to the target count, times absolute by the half-count (0: without)."""
    relative = F.least(F.lit(1.0), n / F.when(target > 0, target).otherwise(1.0))
    return relative * (n / (n + half) if half > 0 else F.lit(1.0))


def interpolated_support(dist: Column, slope: Column, full: float = 1.0, penalty: float = 0.8, guard: Column | None = None) -> Column:
    """Support of an interpolated cell in 0 to 1: less with distance and with slope up to ``full``."""
    base = (1 / (1 + dist)) * (1 - penalty * F.least(F.lit(1.0), slope / (full if full > 0 else 1.0)))
    return base if guard is None else base * guard


def percent(support: Column) -> Column:
    return F.floor(100 * support + 0.5).cast("long")


def inverse_distance(z: np.ndarray, radius: int, nearest: int = 12, power: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Heights with empty (NaN) cells filled, and each cell's distance to data in steps to any of eight neighbours.

    Rings of cells are looked through outwards until ``nearest`` measured ones are found, and one ring more, up to
    ``radius``. A cell with no data that near stays NaN, its distance -1. The outermost ``radius`` cells of the
    array lack part of their surroundings.
    """
    have = ~np.isnan(z)
    value, out = np.where(have, z, 0.0), z.copy()
    wide, full = np.pad(value, radius), np.pad(have.astype(float), radius)
    weight, total, found = np.zeros(z.shape), np.zeros(z.shape), np.zeros(z.shape)
    dist, last = np.where(have, 0, -1), np.full(z.shape, radius)
    n, m = z.shape
    for r in range(1, radius + 1):
        w, v, k = np.zeros(z.shape), np.zeros(z.shape), np.zeros(z.shape)
        for dr in range(-r, r + 1):
            for dc in range(-r, r + 1) if abs(dr) == r else (-r, r):
                at = slice(radius + dr, radius + dr + n), slice(radius + dc, radius + dc + m)
                share = full[at] / np.sqrt(dr * dr + dc * dc) ** power
                w, v, k = w + share, v + share * wide[at], k + full[at]
        open_ = ~have & (r <= last)
        weight, total, found = weight + w * open_, total + v * open_, found + k * open_
        dist[(dist < 0) & (found > 0)] = r
        last = np.where(open_ & (found >= nearest) & (last == radius), min(radius, r + 1), last)
    fill = ~have & (weight > 0)
    out[fill] = total[fill] / weight[fill]
    return out, dist


def horn_slope(z: np.ndarray, size: float, low: tuple[bool, bool], high: tuple[bool, bool]) -> np.ndarray:
    """Horn's slope (rise over run) of the inner cells of ``z``, which has a margin of one cell."""
    return np.hypot(*horn_gradient(z, (size, size), low, high))


def horn_gradient(z: np.ndarray, size: tuple[float, float], low: tuple[bool, bool], high: tuple[bool, bool]) -> tuple[np.ndarray, np.ndarray]:
    """Horn's gradient, to the east and to the north, of the inner cells of ``z``, which has a margin of one cell. ``size`` is a cell's width and height.

    A missing neighbour counts as the centre. Where the margin lies outside the grid (``low``: first rows, first
    columns; ``high``: last ones), it is extrapolated at right angles to the edge and clamped along it; the cell in
    a corner takes first or last rows as its edge.
    """
    z = z.copy()
    n, m = z.shape

    def outside(edge: np.ndarray, inward: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(inward), edge, 2 * edge - inward)

    for at, edge, inward, is_edge in ((0, 1, 2, low[1]), (m - 1, m - 2, m - 3, high[1])):
        if is_edge:
            z[:, at] = outside(z[:, edge], z[:, inward])
    for at, edge, inward, is_edge in ((0, 1, 2, low[0]), (n - 1, n - 2, n - 3, high[0])):
        if is_edge:
            z[at] = outside(z[edge], z[inward])
            if low[1]:
                z[at, 0] = z[at, 1]
            if high[1]:
                z[at, -1] = z[at, -2]

    def gradient(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = z.shape
        centre = z[1:-1, 1:-1]
        window = {(r, c): np.where(np.isnan(x := z[1 + r : n - 1 + r, 1 + c : m - 1 + c]), centre, x) for r in (-1, 0, 1) for c in (-1, 0, 1)}
        across = sum(k * (window[r, 1] - window[r, -1]) for r, k in ((-1, 1), (0, 2), (1, 1)))
        along = sum(k * (window[1, c] - window[-1, c]) for c, k in ((-1, 1), (0, 2), (1, 1)))
        return across / (8 * size[0]), along / (8 * size[1])

    out = gradient(z)
    for r, row_edge in ((0, low[0]), (n - 3, high[0])):
        for c, col_edge in ((0, low[1]), (m - 3, high[1])):
            if row_edge and col_edge:
                corner = z[r : r + 3, c : c + 3].copy()
                side, kept = (0, 1) if c == 0 else (2, 1)
                corner[:, side] = corner[:, kept]
                for whole, own in zip(out, gradient(corner), strict=True):
                    whole[r, c] = own[0, 0]
    return out


#: Eight rays, anticlockwise: rows and columns of a step.
RAYS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def directions(have: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of how many of the eight directions a cell has data within ``radius`` steps, and whether these lie to one side:
    there are some, and an arc of more than 180 degrees has none."""
    n, m = have.shape
    wide = np.pad(have, radius)
    hit = np.zeros((8, n, m), bool)
    for k, (dr, dc) in enumerate(RAYS):
        for t in range(1, radius + 1):
            hit[k] |= wide[radius + dr * t : radius + dr * t + n, radius + dc * t : radius + dc * t + m]
    # An arc of over 180 degrees without data is four directions in a row without any.
    empty = ~hit
    lone = np.any([empty[[(k + j) % 8 for j in range(4)]].all(0) for k in range(8)], axis=0)
    return hit.sum(0), lone & hit.any(0)


def support_field(cells: DataFrame, rows: int, cols: int, size: float = 1.0, radius: int = 8, tile: int = TILE, most_dist: int | None = None, most_slope: float | None = None, guard: int | None = None, penalty: float = 0.5, drop_single: bool = False) -> DataFrame:
    """``site, row, col, n, z, coverage, dist, slope, confidence`` of every measured or interpolated cell of the grid.

    ``cells(site, row, col, n, z)`` are measured and unique. Confidence is in 0 to 100; a site's target count is
    its median. Cells beyond ``radius`` of any data, or past the limits of distance or slope, are gaps and give no
    row. A site without cells gives none. With a ``guard`` radius, the support of interpolated cells whose data lie
    to one side is multiplied by ``penalty``; those with data in one of eight directions only are gaps if ``drop_single``.
    """
    margin = max(radius, guard or 0) + 1
    span = lambda c, upto: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - margin) / tile)), F.least(F.lit((upto - 1) // tile), F.floor((F.col(c) + margin) / tile)))
    sent = cells.select("site", "row", "col", "n", "z").withColumn("tr", F.explode(span("row", rows))).withColumn("tc", F.explode(span("col", cols)))

    def one(key: tuple, t: pa.Table) -> pa.Table:
        site, tr, tc = (k.as_py() for k in key)
        r0, c0 = tr * tile - margin, tc * tile - margin
        z, n = np.full((tile + 2 * margin,) * 2, np.nan), np.zeros((tile + 2 * margin,) * 2, np.int64)
        at = t["row"].to_numpy() - r0, t["col"].to_numpy() - c0
        z[at], n[at] = t["z"].to_numpy(), t["n"].to_numpy()
        filled, dist = inverse_distance(z, radius)
        # Outside of the grid there is nothing to fill.
        row, col = np.arange(r0, r0 + len(z)), np.arange(c0, c0 + len(z))
        inside = ((row >= 0) & (row < rows))[:, None] & ((col >= 0) & (col < cols))
        filled[~inside] = np.nan
        h, w = min(tile, rows - tr * tile), min(tile, cols - tc * tile)
        core = slice(margin, margin + h), slice(margin, margin + w)
        near = filled[margin - 1 : margin + h + 1, margin - 1 : margin + w + 1]
        slope = horn_slope(near, size, (tr == 0, tc == 0), ((tr + 1) * tile >= rows, (tc + 1) * tile >= cols))
        seen, aside = directions(~np.isnan(z), guard) if guard else (np.full(z.shape, 8), np.zeros(z.shape, bool))
        a, b = np.nonzero(~np.isnan(filled[core]))
        pick = lambda x: x[core][a, b]
        count = pick(n)
        return pa.table({
            "site": pa.array([site] * len(a), pa.string()), "row": pa.array((a + tr * tile).astype(np.int32)), "col": pa.array((b + tc * tile).astype(np.int32)), "n": count, "z": pick(filled),
            "coverage": pa.array(np.where(count > 0, "measured", "interpolated").astype(object), pa.string()), "dist": pa.array(pick(dist).astype(np.int32)), "slope": slope[a, b],
            "directions": pa.array(pick(seen).astype(np.int32)), "aside": pick(aside),
        })

    field = sent.groupBy("site", "tr", "tc").applyInArrow(one, SCHEMA)
    target = cells.groupBy("site").agg(F.percentile("n", F.lit(0.5)).alias("target"))
    measured = F.col("coverage") == "measured"
    for column, most in (("dist", most_dist), ("slope", most_slope)):
        if most is not None:
            field = field.where(measured | (F.col(column) <= most))
    if guard and drop_single:
        field = field.where(measured | (F.col("directions") > 1))
    factor = F.when(F.col("aside"), penalty).otherwise(1.0) if guard else None
    confidence = F.when(measured, percent(measured_support(F.col("n"), F.col("target")))).otherwise(percent(interpolated_support(F.col("dist"), F.col("slope"), guard=factor)))
    return field.join(target, "site").withColumn("confidence", confidence).drop("target", "directions", "aside")


def box_extreme(z: np.ndarray, b: int, pick) -> np.ndarray:
    """``np.fmin`` or ``np.fmax`` over the square of ``b`` cells to each side; empty cells (NaN) don't count."""
    for axis in (0, 1):
        n, wide = z.shape[axis], np.pad(z, [(b, b) if k == axis else (0, 0) for k in (0, 1)], constant_values=np.nan)
        z = wide.take(range(n), axis)
        for k in range(1, 2 * b + 1):
            z = pick(z, wide.take(range(k, k + n), axis))
    return z


def opened(cells: DataFrame, rows: int, cols: int, b: int, tile: int = TILE) -> DataFrame:
    """``site, row, col, opened`` of the grid's cells: the greatest, over the square around a cell, of the least heights over squares.

    Empty cells within reach of data have a value, too; tiles have a margin of both squares.
    """
    margin = 2 * b
    span = lambda c, upto: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - margin) / tile)), F.least(F.lit((upto - 1) // tile), F.floor((F.col(c) + margin) / tile)))
    sent = cells.select("site", "row", "col", "z").withColumn("tr", F.explode(span("row", rows))).withColumn("tc", F.explode(span("col", cols)))

    def one(key: tuple, t: pa.Table) -> pa.Table:
        site, tr, tc = (k.as_py() for k in key)
        r0, c0 = tr * tile - margin, tc * tile - margin
        z = np.full((tile + 2 * margin,) * 2, np.nan)
        z[t["row"].to_numpy() - r0, t["col"].to_numpy() - c0] = t["z"].to_numpy()
        low = box_extreme(z, b, np.fmin)
        row, col = np.arange(r0, r0 + len(z)), np.arange(c0, c0 + len(z))
        low[~(((row >= 0) & (row < rows))[:, None] & ((col >= 0) & (col < cols)))] = np.nan
        high = box_extreme(low, b, np.fmax)[margin : margin + min(tile, rows - tr * tile), margin : margin + min(tile, cols - tc * tile)]
        a, c = np.nonzero(~np.isnan(high))
        return pa.table({"site": pa.array([site] * len(a), pa.string()), "row": pa.array((a + tr * tile).astype(np.int32)), "col": pa.array((c + tc * tile).astype(np.int32)), "opened": high[a, c]})

    return sent.groupBy("site", "tr", "tc").applyInArrow(one, "site string, row int, col int, opened double")


def steepest(cells: DataFrame, size: float = 1.0) -> DataFrame:
    """``cells`` with ``steepest``: the greatest difference to one of the four neighbours that are there, by the cell size (none: 0)."""
    out = cells
    for name, along, across in (("__r", "col", "row"), ("__c", "row", "col")):
        order = Window.partitionBy("site", across).orderBy(along)
        for k, (step, move) in enumerate(((F.lag, 1), (F.lead, -1))):
            beside = F.col(along) - step(along).over(order) == move
            out = out.withColumn(f"{name}{k}", F.when(beside, F.abs(F.col("z") - step("z").over(order))))
    most = F.greatest("__r0", "__r1", "__c0", "__c1")
    return out.withColumn("steepest", F.coalesce(most / size, F.lit(0.0))).drop("__r0", "__r1", "__c0", "__c1")
