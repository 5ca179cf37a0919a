"""Nearest data against a plain front and all pairs, with holes far wider than a tile's margin; progressive openings cell by cell."""

import numpy as np
import pytest

from tellurion.operators import ground, nearest


def _front(have, rows, cols):
    """Cell by cell: a front from all data in row-major order, cells taken in the order they are reached."""
    source = {p: p for p in sorted(have)}
    front, dist = list(source), {p: 0 for p in source}
    while front:
        after = []
        for r, c in front:
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    p = r + dr, c + dc
                    if p not in source and 0 <= p[0] < rows and 0 <= p[1] < cols:
                        source[p], dist[p] = source[r, c], dist[r, c] + 1
                        after.append(p)
        front = after
    return {p: (*source[p], dist[p]) for p in source}


def _pairs(have, rows, cols):
    have = sorted(have)
    return {(r, c): (*(best := min(have, key=lambda p: ((p[0] - r) ** 2 + (p[1] - c) ** 2, p))), (best[0] - r) ** 2 + (best[1] - c) ** 2) for r in range(rows) for c in range(cols)}


@pytest.mark.parametrize("straight", [False, True])
def test_nearest(spark, straight):
    rows, cols = 70, 90
    rng = np.random.default_rng(6)
    sites = {
        "few": {(int(r), int(c)) for r, c in zip(rng.integers(0, rows, 6), rng.integers(0, cols, 6), strict=True)},
        "one": {(3, 80)},
        "hole": {(r, c) for r in range(rows) for c in range(cols) if not (10 < r < 60 and 5 < c < 85)},
        "dense": {(r, c) for r in range(rows) for c in range(cols) if rng.random() < 0.4},
    }
    cells = spark.createDataFrame([(s, r, c, r + c / 100) for s, have in sites.items() for r, c in have], "site string, row int, col int, z double")
    got = {}
    for r in nearest.nearest(cells, rows, cols, tile=8, reach=3, straight=straight, value="z").collect():
        assert r["z"] == r["near_row"] + r["near_col"] / 100
        got.setdefault(r["site"], {})[r["row"], r["col"]] = (r["near_row"], r["near_col"], r["dist"])
    for site, have in sites.items():
        assert got[site] == (_pairs if straight else _front)(have, rows, cols), site
    assert nearest.nearest(cells.limit(0), rows, cols).isEmpty()


def _opened(z, rows, cols, b):
    def over(f, x):
        return {(r, c): f(x[p, q] for p in range(max(0, r - b), min(rows, r + b + 1)) for q in range(max(0, c - b), min(cols, c + b + 1))) for r in range(rows) for c in range(cols)}

    return over(max, over(min, z))


def test_progressive_opening(spark):
    rows, cols, widest = 30, 26, 4
    rng = np.random.default_rng(9)
    z = {(r, c): 0.1 * r + rng.normal(0, 0.1) + (6 if 8 < r < 13 and 8 < c < 12 else 0) + (3 if rng.random() < 0.1 else 0) for r in range(rows) for c in range(cols)}
    cells = spark.createDataFrame([("s", r, c, float(v)) for (r, c), v in z.items()], "site string, row int, col int, z double")
    want = dict(z)
    for b in range(1, widest + 1):
        high = _opened(want, rows, cols, b)
        want = {p: high[p] if v - high[p] > min(2.5, 0.5 + 0.15 * b) else v for p, v in want.items()}
    for tile in (8, 64):
        got = {(r["row"], r["col"]): r["z"] for r in ground.surface(cells, rows, cols, widest, tile=tile).collect()}
        assert got == pytest.approx(want)
    assert max(want[r, c] for r in range(9, 13) for c in range(9, 12)) < 3 < min(z[r, c] for r in range(9, 13) for c in range(9, 12))
    assert ground.rounds(4, 8) == [[1, 2], [3], [4]] and ground.tolerance(9, 0.15, 3.0, 2.5, 1.0) == 3.0
    flat = spark.createDataFrame([("s", 0, 0, 0.0), ("s", 0, 1, 2.0)], "site string, row int, col int, z double")
    assert sorted(r["slope"] for r in ground.steepness(flat, 1, 2, 0.5).collect()) == [4.0, 4.0]


def test_ground_of_points(spark):
    points = spark.createDataFrame([("s", 0, c, z, k) for c, z, k in [(0, 0.0, 2), (0, 0.4, 2), (0, 0.6, 1), (0, 9.0, 2), (3, 0.1, 2), (3, float("nan"), 2)]], "site string, row int, col int, z double, class int")
    points = points.selectExpr("*", "0.0 as x", "0.0 as y")
    found = ground.ground_surface(points.where("not isnan(z)"), 1, 4, 1, percent=0)
    assert [(r["col"], r["z"]) for r in found.orderBy("col").collect()] == [(0, 0.0), (1, 0.0), (2, 0.1), (3, 0.1)]
    assert sorted((r["z"], r["ground"]) for r in ground.on_ground(points.where("not isnan(z)"), found).collect()) == [(0.0, True), (0.1, True), (0.4, True), (0.6, False), (9.0, False)]
    assert ground.trusted(points).count() == 4
