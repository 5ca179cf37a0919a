"""Grids cut into square tiles with a margin, so that a task holds what its cells depend on."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def near_tiles(name: str, upto: int, tile: int, margin: int) -> Column:
    """Numbers of the tiles along one axis that a cell lies in or within ``margin`` of."""
    at = lambda d: F.floor((F.col(name) + d) / tile)
    return F.sequence(F.greatest(F.lit(0), at(-margin)), F.least(F.lit((upto - 1) // tile), at(margin)))


def with_margins(cells: DataFrame, rows: int, cols: int, tile: int, margin: int) -> DataFrame:
    """``cells`` once for each tile (``tr``, ``tc``) that needs them."""
    return cells.withColumn("tr", F.explode(near_tiles("row", rows, tile, margin))).withColumn("tc", F.explode(near_tiles("col", cols, tile, margin)))


class Tile:
    """The cells of a tile and its margin as arrays, and the tile's own part of these."""

    def __init__(self, key: tuple, t: pa.Table, rows: int, cols: int, tile: int, margin: int):
        self.site, self.tr, self.tc = (k.as_py() for k in key)
        self.row0, self.col0, self.side = self.tr * tile - margin, self.tc * tile - margin, tile + 2 * margin
        self.table, self.at = t, (t["row"].to_numpy() - self.row0, t["col"].to_numpy() - self.col0)
        self.own = tuple(slice(margin, margin + min(tile, upto - k * tile)) for k, upto in ((self.tr, rows), (self.tc, cols)))
        row, col = np.arange(self.row0, self.row0 + self.side), np.arange(self.col0, self.col0 + self.side)
        self.inside = ((row >= 0) & (row < rows))[:, None] & ((col >= 0) & (col < cols))
        self.margin = margin

    def values(self, name: str, empty=np.nan) -> np.ndarray:
        out = np.full((self.side, self.side), empty)
        out[self.at] = self.table[name].to_numpy()
        return out

    def rows(self, where: np.ndarray, **columns: np.ndarray) -> pa.Table:
        """One row for each of the tile's own cells in ``where`` (an array of the whole), with the columns' values there."""
        a, b = np.nonzero(where[self.own])
        place = {"site": pa.array([self.site] * len(a), pa.string()), "row": pa.array((a + self.row0 + self.margin).astype(np.int32)), "col": pa.array((b + self.col0 + self.margin).astype(np.int32))}
        return pa.table(place | {n: pa.array(v[self.own][a, b]) for n, v in columns.items()})


def over_tiles(cells: DataFrame, rows: int, cols: int, tile: int, margin: int, work: Callable[[Tile], pa.Table], schema: str) -> DataFrame:
    """``work`` on every tile that has cells in it or its margin; its rows have ``site, row, col`` and the columns of ``schema``."""

    def one(key: tuple, t: pa.Table) -> pa.Table:
        return work(Tile(key, t, rows, cols, tile, margin))

    return with_margins(cells, rows, cols, tile, margin).groupBy("site", "tr", "tc").applyInArrow(one, f"site string, row int, col int, {schema}")
