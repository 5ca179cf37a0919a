"""Nearest data of every cell of a grid, however far: by steps to any of eight neighbours, or in a straight line.

A pass over tiles finds what lies within their margin. Tiles with cells left over look for blocks of data in
neighbourhoods of doubling size; the first that has any gives a bound, and only rim cells (those with an empty
neighbour) of blocks within the bound are compared. So the work of a hole grows with its area and rim, not with the grid.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.operators.tiles import Tile, over_tiles
from tellurion.sources.shared import dropped, written

#: Cells a side of a tile, and pairs of a cell and a rim cell that are compared at once.
TILE, PAIRS = 64, 1 << 22
FAR = np.iinfo(np.int64).max
CELL = ["site", "row", "col"]


def by_steps(have: np.ndarray, number: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell of an array the least ``number`` of the data cells at the fewest steps from it, and the steps (-1: over ``radius``).

    A front goes out from all data cells at once. Each cell that it reaches takes the least source of its neighbours in the
    front, which is the least of all data cells that are as near.
    """
    source, dist = np.where(have, number, FAR), np.where(have, 0, -1)
    for step in range(1, radius + 1):
        wide = np.pad(source, 1, constant_values=FAR)
        n, m = source.shape
        across = np.minimum(np.minimum(wide[:, :m], wide[:, 1 : m + 1]), wide[:, 2:])
        best = np.minimum(np.minimum(across[:n], across[1 : n + 1]), across[2:])
        new = (dist < 0) & (best < FAR)
        if not new.any():
            break
        source[new], dist[new] = best[new], step
    return source, dist


def by_lines(have: np.ndarray, number: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the least ``number`` of the data cells at the least straight distance, and that distance squared (-1: over ``radius``).

    Columns first: the nearest data cell above or below. Then along rows, the lower envelope of the parabolas that these give.
    """
    n, m = have.shape
    row = np.arange(n)[:, None]
    above = np.maximum.accumulate(np.where(have, row, -FAR // 4), axis=0)
    below = np.minimum.accumulate(np.where(have, row, FAR // 4)[::-1], axis=0)[::-1]
    # Of two data cells as far in a column the upper one has the lesser number.
    pick = np.where(row - above <= below - row, above, below)
    height = np.abs(row - pick)
    known = height <= radius
    source, dist = np.full((n, m), FAR), np.full((n, m), -1)
    for i in range(n):
        cols = np.nonzero(known[i])[0]
        if not len(cols):
            continue
        h = height[i, cols] ** 2
        stack: list[int] = []  # columns of the envelope
        starts: list[float] = []  # where each is least from
        for k, c in enumerate(cols.tolist()):
            start = -np.inf
            while stack:
                j = stack[-1]
                start = ((h[k] + c * c) - (h[j] + cols[j] ** 2)) / (2 * (c - cols[j]))
                if start < starts[-1]:
                    stack.pop()
                    starts.pop()
                    start = -np.inf
                else:
                    break
            stack.append(k)
            starts.append(start)
        x = np.arange(m)
        hit = np.searchsorted(starts, x, side="right") - 1
        # Where two parabolas meet, both are as near; more than two can.
        best = np.full(m, FAR)
        least = h[np.array(stack)[hit]] + (x - cols[np.array(stack)[hit]]) ** 2
        near = least <= radius * radius
        for j in range(len(stack)):
            lo = max(0, int(np.ceil(starts[j] - 1e-9)) if np.isfinite(starts[j]) else 0)
            hi = m if j + 1 == len(stack) else min(m, int(np.floor(starts[j + 1] + 1e-9)) + 1)
            if lo < hi:
                k = stack[j]
                c = cols[k]
                at = x[lo:hi]
                ok = h[k] + (at - c) ** 2 == least[lo:hi]
                own = number[pick[i, c], c]
                best[lo:hi] = np.where(ok & (own < best[lo:hi]), own, best[lo:hi])
        source[i, near], dist[i, near] = best[near], least[near]
    return source, dist


def _gap(a: Column, b: Column, tile: int) -> Column:
    """Steps along one axis between the nearest cells of two blocks."""
    return F.greatest(F.lit(0), (F.abs(a - b) - 1) * tile + 1) * (a != b).cast("int")


def nearest(cells: DataFrame, rows: int, cols: int, tile: int = TILE, reach: int | None = None, straight: bool = False, value: str | None = None) -> DataFrame:
    """``site, row, col, near_row, near_col, dist`` of every cell of the grid: its nearest cell in ``cells(site, row, col)``, and that cell's ``value``, a double.

    Nearest is by steps to any of eight neighbours, or ``straight``: then ``dist`` is the square of the distance. Of cells as near
    the one in the lowest row counts, then in the lowest column. A cell with data is its own nearest. Sites without
    data have no rows. ``reach`` is the margin of the first pass and changes no result.
    """
    reach = reach or tile // 2
    extra = [value] if value else []
    data = written(cells.select(*CELL, *extra))
    rule, kinds = by_lines if straight else by_steps, "near_row int, near_col int, dist long" + (f", `{value}` double" if value else "")

    def first(t: Tile) -> pa.Table:
        have = t.values("row", -1) >= 0
        number = np.arange(t.side, dtype=np.int64)[:, None] * t.side + np.arange(t.side)
        source, dist = rule(have, number, reach)
        source = np.where(dist >= 0, source, 0)
        # A rim cell has an empty neighbour in the grid.
        filled = np.pad(have | ~t.inside, 1, constant_values=True)
        n = t.side
        full = np.ones_like(have)
        for r in range(3):
            for c in range(3):
                full &= filled[r : r + n, c : c + n]
        carried = {v: t.values(v).ravel()[source] for v in extra}
        return t.rows((dist >= 0) & t.inside, near_row=(source // t.side + t.row0).astype(np.int32), near_col=(source % t.side + t.col0).astype(np.int32), dist=dist.astype(np.int64), **carried, rim=have & ~full)

    near = written(over_tiles(data, rows, cols, tile, reach, first, f"{kinds}, rim boolean"))
    block = {"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)}
    done = near.withColumns(block).groupBy("site", "tr", "tc").agg(F.count("*").alias("done"))
    tiles_of = lambda upto: F.sequence(F.lit(0).cast("long"), F.lit((upto - 1) // tile).cast("long"))
    every = data.select("site").distinct().withColumn("tr", F.explode(tiles_of(rows))).withColumn("tc", F.explode(tiles_of(cols)))
    area = F.least(F.lit(tile), rows - F.col("tr") * tile) * F.least(F.lit(tile), cols - F.col("tc") * tile)
    left = written(every.join(done, ["site", "tr", "tc"], "left").where(F.coalesce("done", F.lit(0)) < area).select("site", "tr", "tc"))
    out = near.drop("rim")
    if left.isEmpty():
        dropped(left, data)
        return out
    rim = near.where("rim").select(*CELL, *extra).withColumns({"br": F.floor(F.col("row") / tile), "bc": F.floor(F.col("col") / tile)})
    blocks = written(rim.select("site", "br", "bc").distinct())
    levels = max(1, (max(rows, cols) - 1) // tile).bit_length() + 1
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    scaled = lambda c: F.expr(f"shiftright({c}, level)")

    def around(df: DataFrame, n: int) -> DataFrame:
        """Each tile with the blocks of its level up to ``n`` away."""
        steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-n, n + 1) for b in range(-n, n + 1)))
        return df.withColumn("s", F.explode(steps)).withColumns({"kr": scaled("tr") + F.col("s.a"), "kc": scaled("tc") + F.col("s.b")}).drop("s")

    coarse = blocks.select("site", "br", "bc", level).withColumns({"kr": scaled("br"), "kc": scaled("bc")})
    seen = around(left.select("site", "tr", "tc", level), 1).join(coarse.select("site", "level", "kr", "kc").distinct(), ["site", "level", "kr", "kc"])
    found = seen.groupBy("site", "tr", "tc").agg(F.min("level").alias("level"))
    # All cells of a tile have data in the blocks of that level beside its own, so less than twice a block's side away along either axis.
    pairs = written(around(found, 3 if straight else 2).join(coarse, ["site", "level", "kr", "kc"]).select("site", "tr", "tc", "br", "bc"))
    far = lambda a, b: (F.abs(F.col(a) - F.col(b)) + 1) * tile - 1
    low = [_gap(F.col(a), F.col(b), tile) for a, b in (("tr", "br"), ("tc", "bc"))]
    high = [far("tr", "br"), far("tc", "bc")]
    least, most = (low[0] * low[0] + low[1] * low[1], high[0] * high[0] + high[1] * high[1]) if straight else (F.greatest(*low), F.greatest(*high))
    bound = pairs.groupBy("site", "tr", "tc").agg(F.min(most).alias("bound"))
    chosen = pairs.join(bound, ["site", "tr", "tc"]).where(least <= F.col("bound")).select("site", "tr", "tc", "br", "bc")
    sent = chosen.join(rim, ["site", "br", "bc"]).select(*CELL, *extra, "tr", "tc")

    def second(key: tuple, t: pa.Table) -> pa.Table:
        site, tr, tc = (k.as_py() for k in key)
        h, w = min(tile, rows - tr * tile), min(tile, cols - tc * tile)
        r, c = (x.ravel() for x in np.meshgrid(np.arange(tr * tile, tr * tile + h), np.arange(tc * tile, tc * tile + w), indexing="ij"))
        rr, rc = t["row"].to_numpy(), t["col"].to_numpy()
        order = np.lexsort((rc, rr))
        rr, rc = rr[order].astype(np.int64), rc[order].astype(np.int64)
        carried = {v: t[v].to_numpy()[order] for v in extra}
        best, dist = np.zeros(len(r), np.int64), np.full(len(r), FAR)
        for a in range(0, len(rr), step := max(1, PAIRS // len(r))):
            dr, dc = np.abs(r[:, None] - rr[a : a + step]), np.abs(c[:, None] - rc[a : a + step])
            d = dr * dr + dc * dc if straight else np.maximum(dr, dc)
            k = d.argmin(1)
            d = d[np.arange(len(r)), k]
            better = d < dist
            best[better], dist[better] = k[better] + a, d[better]
        place = {k: pa.array(v.astype(np.int32)) for k, v in (("row", r), ("col", c), ("near_row", rr[best]), ("near_col", rc[best]))}
        return pa.table({"site": pa.array([site] * len(r), pa.string())} | place | {"dist": dist} | {v: x[best] for v, x in carried.items()})

    rest = sent.groupBy("site", "tr", "tc").applyInArrow(second, f"site string, row int, col int, {kinds}")
    # What the first pass knew of these tiles holds, data cells among it.
    more = written(rest.join(near.select(*CELL), CELL, "left_anti"))
    dropped(left, data, blocks, pairs)
    return out.unionByName(more)


def inpainted(cells: DataFrame, rows: int, cols: int, tile: int = TILE, reach: int | None = None) -> DataFrame:
    """``site, row, col, z, had_data`` of every cell of the grid: its height in ``cells(site, row, col, z)``, or that of the nearest cell there by steps."""
    return nearest(cells, rows, cols, tile, reach, value="z").select(*CELL, "z", (F.col("dist") == 0).alias("had_data"))
