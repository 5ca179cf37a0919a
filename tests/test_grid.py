"""Grids and statistics against plain restatements: binning at edges, fills by tiles, slopes, draws, running sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.operators import fill, grid, statistics


def test_binning_at_edges(spark):
    """Points on edges, on the far corner, a little and clearly outside, and without numbers."""
    rows = [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (2.0 + 1e-7, 1.0), (2.001, 1.0), (-1e-7, 0.5), (0.5, 1.0), (1.5, 1.5), (float("nan"), 1.0), (1.0, float("inf"))]
    p = spark.createDataFrame([("s", x, y, 1.0) for x, y in rows] + [("s", 0.5, 0.5, float("-inf")), ("s", None, 0.5, 1.0)], "site string, x double, y double, z double")

    def cells(df):
        return sorted((r["row"], r["col"]) for r in df.collect())

    assert cells(grid.to_cells(p, 2, 2)) == sorted([(0, 0), (1, 1), (1, 1), (1, 1), (0, 0), (1, 0), (1, 1)])
    assert cells(grid.binned(p, 2, 2)) == sorted([(0, 0), (1, 1), (1, 0), (1, 1)])
    assert cells(grid.binned(p, 2, 2, north_up=True)) == sorted([(0, 1), (0, 0), (1, 1)])
    assert cells(grid.binned(p, 2, 2, **grid.BINNING["north_up_1mm_boundary"])) == sorted([(0, 0), (0, 1), (1, 1), (0, 1), (0, 0), (0, 0), (1, 1)])
    assert cells(grid.binned(p, 2, 2, centres=True)) == sorted([(1, 1), (1, 0), (1, 1)])
    got = grid.accounting(p, 2, 2).first()
    assert (got["source"], got["skipped"], got["outside"], got["analysed"], got["filled"]) == (12, 4, 1, 7, 3)
    assert got["warnings"] == "4 not finite; 1 outside; 1 cells empty"
    assert tuple(grid.extents(p.where("x = 2.001 or x = 0"), 1.0).first())[1:] == (0.0, 0.0, 3, 2)


def test_floor_and_robust_cells(spark):
    cells = spark.createDataFrame([("s", 0, c, z) for c, zs in enumerate([[10.0, 10.0, 10.0, 50.0], [5.0], [-90.0, 3.0, 4.0], [2.0, 1.0]]) for z in zs], "site string, row int, col int, z double")
    assert [r["robust"] for r in grid.robust_raster(cells).orderBy("col").collect()] == [10.0, 5.0, pytest.approx(3.5), 1.5]
    assert [r["floor"] for r in grid.despiked(cells, 5).orderBy("col").collect()] == [10.0, 5.0, 3.0, 1.0]
    assert [r["floor"] for r in grid.despiked(cells, 0).orderBy("col").collect()] == [10.0, 5.0, -90.0, 1.0]
    assert [grid.quantile_level(p) for p in (0.3, -1, 2, float("nan"), float("inf"))] == [0.3, 0.0, 1.0, 0.5, 0.5]
    graded = spark.createDataFrame([(66.0,), (33.0,), (32.9,), (float("nan"),), (float("inf"),), (None,)], "c double").select(grid.grade(F.col("c")).alias("g"))
    assert [r["g"] for r in graded.collect()] == ["solid", "dashed", "gap", "gap", "gap", "gap"]


def test_support_functions(spark):
    n = spark.range(1, 41).select(fill.measured_support(F.col("id"), F.lit(10)).alias("m")).collect()
    assert [r["m"] for r in n] == sorted(r["m"] for r in n) and n[0]["m"] == pytest.approx(0.025) and n[39]["m"] == pytest.approx(0.930, abs=1e-3)
    d = spark.range(1, 5).select(fill.interpolated_support(F.col("id"), F.lit(0.0)).alias("i")).collect()
    assert [r["i"] for r in d] == pytest.approx([1 / 2, 1 / 3, 1 / 4, 1 / 5])


def _field_plain(have, rows, cols, radius):
    """Ring search and distances, cell by cell."""
    out = {}
    for r in range(rows):
        for c in range(cols):
            if (r, c) in have:
                out[r, c] = (have[r, c], 0)
                continue
            w = v = found = 0
            dist, last = None, radius
            for ring in range(1, radius + 1):
                if ring > last:
                    break
                for (i, j), z in have.items():
                    if max(abs(i - r), abs(j - c)) == ring:
                        share = 1 / ((i - r) ** 2 + (j - c) ** 2)
                        w, v, found, dist = w + share, v + share * z, found + 1, dist or ring
                if found >= 12 and last == radius:
                    last = min(radius, ring + 1)
            if found:
                out[r, c] = (v / w, dist)
    return out


def test_field_by_tiles(spark):
    rng = np.random.default_rng(2)
    have = {(int(r), int(c)): float(rng.normal() + r) for r, c in zip(rng.integers(0, 30, 150), rng.integers(0, 26, 150), strict=True) if not (8 < r < 22 and 6 < c < 18)}
    cells = spark.createDataFrame([("s", r, c, 1 + (r + c) % 5, z) for (r, c), z in have.items()], "site string, row int, col int, n long, z double")
    fields = [{(r["row"], r["col"]): r for r in fill.support_field(cells, 30, 26, radius=4, tile=t).collect()} for t in (64, 7, 10)]
    plain = _field_plain(have, 30, 26, 4)
    assert {k: (pytest.approx(r["z"]), r["dist"]) for k, r in fields[0].items()} == plain
    for other in fields[1:]:
        assert {k: (pytest.approx(r["z"]), r["dist"], pytest.approx(r["slope"], abs=1e-12), r["confidence"]) for k, r in other.items()} == {k: (r["z"], r["dist"], r["slope"], r["confidence"]) for k, r in fields[0].items()}
    near = fill.support_field(cells, 30, 26, radius=4, most_dist=1)
    assert {r["coverage"] for r in near.where("dist > 1").collect()} == set()
    assert fill.support_field(cells.limit(0), 30, 26).isEmpty()


def test_slope_of_a_plane():
    r, c = np.mgrid[-1:9, -1:9].astype(float)
    plane = 2 * r + 3 * c
    edge = plane.copy()
    edge[[0, -1]], edge[:, [0, -1]] = np.nan, np.nan
    got = fill.horn_slope(edge, 1.0, (True, True), (True, True))
    assert np.allclose(got[1:-1, 1:-1], math.hypot(2, 3)) and np.allclose(got[0, 1:-1], math.hypot(2, 3)) and np.allclose(got[1:-1, 0], math.hypot(2, 3))
    assert all(not math.isclose(got[i, j], math.hypot(2, 3)) for i in (0, -1) for j in (0, -1))


def _mulberry(seed):
    a, mask = seed, 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & mask
        t = ((a ^ a >> 15) * (a | 1)) & mask
        t = ((t + (((t ^ t >> 7) * (t | 61)) & mask)) & mask) ^ t
        yield ((t ^ t >> 14) & mask) / 4294967296


def test_draws(spark):
    want = _mulberry(0xC0FFEE)
    got = statistics.with_draw(spark.range(500), 0xC0FFEE, F.col("id"), "u").orderBy("id").collect()
    assert [r["u"] for r in got] == [next(want) for _ in range(500)]


def test_running_sums_and_medians(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v), int(w)) for g in "ab" for v, w in zip(rng.permutation(3000), rng.integers(1, 9, 3000), strict=True)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    got = {(r["g"], r["v"]): r["upto"] for r in statistics.running(df, "g", "v", "w").collect()}
    for g in "ab":
        total = 0
        for _, v, w in sorted(r for r in rows if r[0] == g):
            total += w
            assert got[g, v] == total
    for r in statistics.weighted_median(df, "g", "v", "w").collect():
        mine = sorted((v, w) for g, v, w in rows if g == r["g"])
        half, upto = sum(w for _, w in mine) / 2, np.cumsum([w for _, w in mine])
        assert r["median"] == mine[int(np.searchsorted(upto, half))][0]
    numbers = statistics.numbered(spark.range(0, 5000, 3), "id").collect()
    assert sorted(r["number"] for r in numbers) == list(range(len(numbers)))
    values = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>")
    assert tuple(values.select(statistics.lower_quantile(F.col("v"), 0.9), statistics.upper_median(F.col("v"))).first()) == (3.0, 3.0)
