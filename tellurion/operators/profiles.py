"""Other support profiles of a field: the same cells and heights, another confidence. Each is a callable on the field."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.operators.statistics import running
from tellurion.operators.tiles import Tile, over_tiles

#: Fixed values of the survey profile: instrument error, tolerance, slope of the interpolation error.
INSTRUMENT, TOLERANCE, SLOPE = 0.05, 0.10, 0.05
#: Fixed values of the kriging profile: range of the covariance in cells, nugget of one point, cells used and how far they are looked for.
RANGE, NUGGET, USED, REACH = 3.0, 0.5, 8, 6


def _rounded(value):
    return F.floor(value + 0.5).cast("long")


def exponential(field: DataFrame) -> DataFrame:
    """Measured cells by their count, interpolated ones by their distance, both exponentially."""
    return field.withColumn("confidence", _rounded(F.when(F.col("coverage") == "measured", 100 * (1 - F.exp(-F.col("n") / 2))).otherwise(50 * F.exp(-(F.col("dist") - 1) / 1.5))))


def standard_errors(cells: DataFrame) -> DataFrame:
    """``site, row, col, se`` of points in cells: of the mean height, from the cell's spread and the instrument's error."""
    spread = F.coalesce(F.var_samp("z"), F.lit(0.0))
    return cells.groupBy("site", "row", "col").agg(F.sqrt((spread + INSTRUMENT**2) / F.count("*")).alias("se"))


def survey(field: DataFrame, errors: DataFrame, size: float = 1.0) -> DataFrame:
    """By the standard error; of interpolated cells, by that of the site's middle cell (of two, the greater) and what it grows with distance."""
    ranked = running(errors.groupBy("site", "se").agg(F.count("*").alias("w")), "site", "se", "w")
    half = errors.groupBy("site").agg(F.floor(F.count("*") / 2).alias("half"))
    mid = ranked.join(half, "site").where(F.col("upto") > F.col("half")).groupBy("site").agg(F.min("se").alias("se_mid"))
    placed = field.join(errors, ["site", "row", "col"], "left").join(mid, "site")
    e = F.when(F.col("coverage") == "measured", F.col("se")).otherwise(F.sqrt(F.col("se_mid") * F.col("se_mid") + F.pow(SLOPE * F.col("dist") * size, 2)))
    return placed.withColumn("confidence", _rounded(100 * F.exp(-(e * e) / (2 * TOLERANCE**2)))).drop("se", "se_mid")


def _offsets(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells around one, by distance and then in row order, and their distances from each other."""
    r, c = (x.ravel() for x in np.meshgrid(np.arange(-reach, reach + 1), np.arange(-reach, reach + 1), indexing="ij"))
    order = np.lexsort((c, r, r * r + c * c))
    at = np.stack([r[order], c[order]], axis=1)
    return at, np.sqrt(((at[:, None] - at[None]) ** 2).sum(2).astype(float))


def nearest_cells(have: np.ndarray, at: np.ndarray, offsets: np.ndarray, used: int) -> np.ndarray:
    """For each cell (a row, col in ``at``) the first ``used`` of ``offsets`` that lie in ``have``, -1 beyond the last. ``have`` has room around."""
    hit = have[at[:, 0, None] + offsets[:, 0], at[:, 1, None] + offsets[:, 1]]
    rank = np.cumsum(hit, axis=1)
    out = np.full((len(at), used), -1)
    cell, k = np.nonzero(hit & (rank <= used))
    out[cell, rank[cell, k] - 1] = k
    return out


def kriging(field: DataFrame, rows: int, cols: int, tile: int = 64) -> DataFrame:
    """By the variance that is left of a height of variance 1 if the ``USED`` nearest measured cells within ``REACH`` cells are known.

    Covariance falls exponentially with distance; a cell's own mean has a nugget by its count. Cells with no measured
    one that near have confidence 0. ``field(site, row, col, n, coverage, ...)`` keeps its other columns.
    """
    offsets, apart = _offsets(REACH)
    kinds = {f.name: f.dataType.simpleString() for f in field.schema if f.name not in ("site", "row", "col", "confidence")}

    def one(t: Tile) -> pa.Table:
        count = t.values("n", 0.0) * (t.values("__measured", 0.0) > 0)
        own = (t.at[0] >= t.own[0].start) & (t.at[0] < t.own[0].stop) & (t.at[1] >= t.own[1].start) & (t.at[1] < t.own[1].stop)
        at = np.stack([t.at[0][own], t.at[1][own]], axis=1)
        pick = nearest_cells(count > 0, at, offsets, USED)
        there = pick >= 0
        k = np.where(there, pick, 0)
        known = count[at[:, 0, None] + offsets[k, 0], at[:, 1, None] + offsets[k, 1]]
        c = np.exp(-apart[k[:, :, None], k[:, None, :]] / RANGE) * (there[:, :, None] & there[:, None, :])
        d = np.arange(USED)
        c[:, d, d] = np.where(there, 1 + NUGGET / np.where(known > 0, known, 1), 1.0)
        v = np.exp(-np.hypot(offsets[k, 0], offsets[k, 1]) / RANGE) * there
        share = (np.linalg.solve(c, v[:, :, None])[:, :, 0] * v).sum(1)
        out = t.table.filter(pa.array(own)).select(["site", "row", "col", *kinds])
        return out.append_column("confidence", pa.array(np.floor(100 * np.clip(share, 0, 1) + 0.5).astype(np.int64)))

    marked = field.withColumn("__measured", (F.col("coverage") == "measured").cast("double"))
    return over_tiles(marked, rows, cols, tile, REACH, one, ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + ", confidence long")
