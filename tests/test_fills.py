"""Fills over the ground and support by kriging against plain restatements, whatever the tiles."""

import heapq
import math

import numpy as np
import pytest

from tellurion.operators import fill, geodesic, profiles


def _geodesic(z, rows, cols, under, radius, size=(1.0, 1.0), near=12):
    out = {}
    for start in under:
        if start in z:
            out[start] = z[start]
            continue
        cost, queue, done, found = {start: 0.0}, [(0.0, start)], set(), []
        while queue and len(found) < near:
            d, p = heapq.heappop(queue)
            if p in done:
                continue
            done.add(p)
            if p in z:
                found.append((d, z[p]))
                continue
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    q = p[0] + dr, p[1] + dc
                    if q == p or q not in under or max(abs(q[0] - start[0]), abs(q[1] - start[1])) > radius:
                        continue
                    e = d + math.sqrt((dc * size[0]) ** 2 + (dr * size[1]) ** 2 + (under[q] - under[p]) ** 2)
                    if e < cost.get(q, math.inf):
                        cost[q] = e
                        heapq.heappush(queue, (e, q))
        out[start] = sum(v / d**2 for d, v in found) / sum(1 / d**2 for d, _ in found) if found else under[start]
    return out


@pytest.mark.parametrize("size", [(1.0, 1.0), (0.5, 2.0)])
def test_geodesic_fill(spark, size):
    """Two plains with a wall between them: a cell beside the wall is filled from its own side."""
    rows, cols, radius = 22, 30, 5
    rng = np.random.default_rng(2)
    z = {(r, c): (0.0 if c < 14 else 40.0) + 0.1 * r + 0.07 * c + rng.normal(0, 0.05) for r in range(rows) for c in range(cols) if rng.random() < 0.45 and not (5 < r < 9 and 17 < c < 29)}
    grid = np.full((rows + 2 * radius, cols + 2 * radius), np.nan)
    for (r, c), v in z.items():
        grid[r + radius, c + radius] = v
    filled = fill.inverse_distance(grid, radius)[0][radius:-radius, radius:-radius]
    under = {(r, c): float(filled[r, c]) for r in range(rows) for c in range(cols) if not np.isnan(filled[r, c])}
    want = _geodesic(z, rows, cols, under, radius, size)
    cells = spark.createDataFrame([("s", r, c, float(v)) for (r, c), v in z.items()], "site string, row int, col int, z double")
    for tile in (8, 64):
        got = geodesic.geodesic_fill(cells, rows, cols, size, radius=radius, tile=tile).collect()
        assert {(r["row"], r["col"]): r["z"] for r in got} == pytest.approx(want)
        assert all(r["measured"] == ((r["row"], r["col"]) in z) for r in got)
    assert geodesic.geodesic_fill(cells.limit(0), rows, cols).isEmpty()


def test_kriging(spark):
    rows, cols = 20, 24
    rng = np.random.default_rng(3)
    n = {(r, c): int(rng.integers(1, 9)) for r in range(rows) for c in range(cols) if rng.random() < (0.5 if c < 12 else 0.01)}
    field = [("s", r, c, n.get((r, c)) or 0, "measured" if (r, c) in n else "interpolated", 0.5, 7) for r in range(rows) for c in range(cols) if (r + c) % 11]
    have = {(r, c): k for (r, c), k in n.items() if (r + c) % 11}
    got = profiles.kriging(spark.createDataFrame(field, "site string, row int, col int, n long, coverage string, z double, confidence int"), rows, cols, tile=8).collect()
    assert len(got) == len(field)
    for row in got:
        r, c = row["row"], row["col"]
        near = sorted((math.hypot(p[0] - r, p[1] - c), p) for p in have if max(abs(p[0] - r), abs(p[1] - c)) <= 6)[:8]
        share = 0.0
        if near:
            m = np.array([[math.exp(-math.dist(p, q) / 3) + (0.5 / have[p] if p == q else 0) for _, q in near] for _, p in near])
            v = np.array([math.exp(-h / 3) for h, _ in near])
            share = v @ np.linalg.solve(m, v)
        assert row["confidence"] == math.floor(100 * min(1, max(0, share)) + 0.5) and row["z"] == 0.5
