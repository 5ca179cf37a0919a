"""Ground by progressive opening: the floor of a grid, opened by growing squares, and the points that lie on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.operators.fill import horn_gradient
from tellurion.operators.grid import despiked, finite
from tellurion.operators.nearest import CELL, inpainted
from tellurion.operators.tiles import Tile, over_tiles

#: Slope, base tolerance and its cap in heights' unit, percentile of the despiked floor.
SLOPE, BASE, CAP, FLOOR = 0.15, 0.5, 2.5, 5
TILE = 64


def extreme(z: np.ndarray, b: int, pick) -> np.ndarray:
    """``np.fmin`` or ``np.fmax`` over the square of ``b`` cells to each side, by squares of doubling size; NaN doesn't count."""
    for axis in (0, 1):
        n = z.shape[axis]
        z = np.pad(z, [(b, b) if k == axis else (0, 0) for k in (0, 1)], constant_values=np.nan)
        have, width = 1, 2 * b + 1
        while have < width:
            move = min(have, width - have)
            z = pick(z.take(range(z.shape[axis] - move), axis), z.take(range(move, z.shape[axis]), axis))
            have += move
        z = z.take(range(n), axis)
    return z


def tolerance(b: float, slope: float, base: float, cap: float, size: float) -> float:
    return min(max(cap, base), base + slope * b * size)


def rounds(widest: int, budget: int) -> list[list[int]]:
    """Radii 1 to ``widest`` in groups whose margins (two radii each) sum up to ``budget`` at most, or hold one."""
    out: list[list[int]] = []
    for b in range(1, widest + 1):
        if out and 2 * (sum(out[-1]) + b) <= budget:
            out[-1].append(b)
        else:
            out.append([b])
    return out


def surface(filled: DataFrame, rows: int, cols: int, widest: int, slope: float = SLOPE, base: float = BASE, cap: float = CAP, size: float = 1.0, tile: int = TILE) -> DataFrame:
    """``site, row, col, z`` of every cell in ``filled(site, row, col, z)``: its floor, cut to openings by squares of radius 1 to ``widest``.

    At each radius a cell is cut to the opened height if it is more than ``base + slope * radius * size`` above (never more
    than ``cap``, or ``base`` if that is greater). A shuffle serves as many radii as the margin of a tile allows.
    """

    def work(bs: list[int], margin: int):
        def one(t: Tile) -> pa.Table:
            z = t.values("z")
            for b in bs:
                low = extreme(z, b, np.fmin)
                low[~t.inside] = np.nan
                high = extreme(low, b, np.fmax)
                z = np.where(z - high > tolerance(b, slope, base, cap, size), high, z)
            return t.rows(~np.isnan(z) & t.inside, z=z)

        return one

    for bs in rounds(widest, tile):
        margin = 2 * sum(bs)
        filled = over_tiles(filled.select(*CELL, "z"), rows, cols, tile, margin, work(bs, margin), "z double")
    return filled


def steepness(heights: DataFrame, rows: int, cols: int, size: float = 1.0, tile: int = TILE) -> DataFrame:
    """``heights`` with ``slope``: the greatest difference to one of the four neighbours, by ``size``."""

    def one(t: Tile) -> pa.Table:
        z = t.values("z")
        wide = np.pad(z, 1, constant_values=np.nan)
        n = t.side
        most = np.zeros(z.shape)
        for r, c in ((0, 1), (2, 1), (1, 0), (1, 2)):
            most = np.fmax(most, np.abs(z - wide[r : r + n, c : c + n]))
        return t.rows(~np.isnan(z), z=z, slope=most / size)

    return over_tiles(heights.select(*CELL, "z"), rows, cols, tile, 1, one, "z double, slope double")


def derivatives(heights: DataFrame, rows: int, cols: int, size: tuple[float, float] = (1.0, 1.0), high: float = 1.0, tile: int = TILE) -> DataFrame:
    """``site, row, col, slope, aspect, synthesised`` of the cells of ``heights(site, row, col, z)``.

    Slope (rise over run) and aspect (the direction downhill, anticlockwise from the east in radians; 0 where it is flat) by Horn's window, on cells
    ``size`` wide and high with a unit of height ``high`` times theirs. ``synthesised`` marks cells whose window leaves the grid or
    has an empty neighbour, so that some of it is no height of the grid.
    """

    def one(t: Tile) -> pa.Table:
        z = t.values("z")
        # Cut to the grid, so that the margin is the cells just beyond it.
        n, m = (k.stop + 1 for k in t.own)
        dx, dy = horn_gradient(z[:n, :m], size, (t.tr == 0, t.tc == 0), ((t.tr + 1) * tile >= rows, (t.tc + 1) * tile >= cols))
        missing = np.isnan(z)
        halo = np.any([missing[r : n - 2 + r, c : m - 2 + c] for r in range(3) for c in range(3)], axis=0)
        filled = {"slope": np.hypot(dx, dy) * high, "aspect": np.where((dx == 0) & (dy == 0), 0.0, np.arctan2(-dy, -dx)), "synthesised": halo}
        columns = {k: np.zeros(z.shape, v.dtype) for k, v in filled.items()}
        for k, v in filled.items():
            columns[k][1 : n - 1, 1 : m - 1] = v
        return t.rows(~missing, **columns)

    return over_tiles(heights.select(*CELL, "z"), rows, cols, tile, 1, one, "slope double, aspect double, synthesised boolean")


def ground_surface(placed: DataFrame, rows: int, cols: int, widest: int, slope: float = SLOPE, base: float = BASE, cap: float = CAP, percent: float = FLOOR, size: float = 1.0, tile: int = TILE) -> DataFrame:
    """``site, row, col, z, slope`` of the ground under ``placed(site, row, col, z)`` points."""
    floor = despiked(placed, percent).select(*CELL, F.col("floor").alias("z"))
    return steepness(surface(inpainted(floor, rows, cols, tile), rows, cols, widest, slope, base, cap, size, tile), rows, cols, size, tile)


def on_ground(points: DataFrame, ground: DataFrame, base: float = BASE, scale: float = 0.0, cap: float = CAP) -> DataFrame:
    """``points(site, row, col, z, ...)`` with ``surface`` under them and whether they are ``ground``: not above it by more than ``base``
    and ``scale`` times its slope (``cap`` at most)."""
    met = points.join(ground.select(*CELL, F.col("z").alias("surface"), "slope"), CELL)
    most = F.least(F.lit(float(max(cap, base))), base + scale * F.col("slope"))
    return met.withColumn("ground", F.col("z") - F.col("surface") <= most).drop("slope")


def trusted(points: DataFrame, class_column: str = "class", ground_class: int = 2) -> DataFrame:
    """Finite points that are classed as ground by who took them; no test of theirs."""
    is_ground: Column = F.col(class_column) == ground_class
    return points.where(is_ground & finite(F.col("x"), F.col("y"), F.col("z")))
