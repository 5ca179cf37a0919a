"""Heights of empty cells by distance over the ground: a search from each over its surroundings, tile by tile."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tellurion.operators.fill import inverse_distance
from tellurion.operators.tiles import Tile, over_tiles

#: Cells that are blended, power of their distance, and cells to each side that are searched.
NEAREST, POWER, RADIUS = 12, 2.0, 24
TILE = 64


def searched(walk: list, n: int, start: int, near: int, high: float, steps: list, measured: list, radius: int, power: float) -> float | None:
    """Height at ``start``: the mean of the first ``near`` measured cells that a search over ``walk`` comes to, by their distance to the ``power``.

    ``walk`` holds heights row by row, ``n`` a row, NaN where there is no way. A step costs its length over the ground. The
    search doesn't go through measured cells, nor ``radius`` beyond the start; of cells as near the first in row order counts.
    """
    r0, c0 = divmod(start, n)
    best, done, queue = {start: 0.0}, set(), [(0.0, start)]
    weight = total = 0.0
    found = 0
    while queue and found < near:
        cost, at = heapq.heappop(queue)
        if at in done:
            continue
        done.add(at)
        if measured[at]:
            w = 1 / cost**power
            weight, total, found = weight + w, total + w * walk[at], found + 1
            continue
        r, c = divmod(at, n)
        for dr, dc, square in steps:
            if abs(r + dr - r0) > radius or abs(c + dc - c0) > radius:
                continue
            to = at + dr * n + dc
            rise = (walk[to] - walk[at]) * high
            if rise != rise:
                continue
            there = cost + math.sqrt(square + rise * rise)
            if there < best.get(to, math.inf):
                best[to] = there
                heapq.heappush(queue, (there, to))
    return total / weight if weight > 0 else None


def geodesic_fill(cells: DataFrame, rows: int, cols: int, size: tuple[float, float] = (1.0, 1.0), high: float = 1.0, nearest: int = NEAREST, power: float = POWER, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``site, row, col, z, measured`` of the cells in ``cells(site, row, col, z)`` and of the empty ones that can be filled.

    An empty cell is a blend of the ``nearest`` measured cells by the length of the way over the ground there, within ``radius`` cells. The
    ground under the way is that of a fill by straight distance, which also stands where no measured cell is come to;
    cells that it doesn't reach have no row. ``size`` is a cell's width and height, ``high`` a unit of height, in metres.
    Tiles have a margin for the search and for the fill under it, so no result depends on them.
    """
    wide, tall = (s if s > 0 and math.isfinite(s) else 1.0 for s in size)
    steps = [(dr, dc, (tall * tall if dr else 0.0) + (wide * wide if dc else 0.0)) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]

    def one(t: Tile) -> pa.Table:
        z = t.values("z")
        under, _ = inverse_distance(z, radius, nearest, power)
        under[~t.inside] = np.nan
        # A border without ways, so that no step leaves the array.
        walk = np.pad(under, 1, constant_values=np.nan)
        n = walk.shape[1]
        have = np.pad(~np.isnan(z), 1).ravel().tolist()
        flat = walk.ravel().tolist()
        out = under.copy()
        rows_, cols_ = np.nonzero(np.isnan(z[t.own]) & ~np.isnan(under[t.own]))
        for r, c in zip((rows_ + t.margin).tolist(), (cols_ + t.margin).tolist(), strict=True):
            found = searched(flat, n, (r + 1) * n + c + 1, nearest, high, steps, have, radius, power)
            if found is not None:
                out[r, c] = found
        return t.rows(~np.isnan(out) & t.inside, z=out, measured=~np.isnan(z))

    return over_tiles(cells.select("site", "row", "col", "z"), rows, cols, tile, 2 * radius, one, "z double, measured boolean")
