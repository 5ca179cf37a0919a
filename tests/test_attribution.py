"""Chords, source blocks and polygons on small cases: edges, corners, vertices on the ray, rings in rings."""

import math

import numpy as np
from pyspark.sql import functions as F

from tellurion.operators import attribution, chords, contours, stitching


def _passes(x1, y1, x2, y2, r, c):
    """Whether the chord has a point in the cell's interior, by the ends of its part in the closed cell."""
    low, high = 0.0, 1.0
    for a, d, edge in ((x1, x2 - x1, c), (y1, y2 - y1, r)):
        if d == 0:
            if not edge < a < edge + 1:
                return False
        else:
            s, t = sorted(((edge - a) / d, (edge + 1 - a) / d))
            low, high = max(low, s), min(high, t)
    return high - low > 1e-9


def test_chords_over_cells(spark):
    rng = np.random.default_rng(5)
    lines = [(k, *map(float, rng.uniform(-1, 9, 4))) for k in range(300)]
    lines += [(300, 2.0, 0.5, 2.0, 7.5), (301, 0.0, 0.0, 8.0, 8.0), (302, 2.5, 2.5, 2.5, 2.5), (303, 3.0, 1.0, 1.0, 3.0), (304, -5.0, 2.5, 20.0, 2.5), (305, 2.0, 2.0, 2.0, 2.0), (306, -3.0, -3.0, -1.0, -1.0)]
    gaps = {(2, 2), (0, 7), (5, 1), (7, 7)}
    given = spark.createDataFrame([("s", *x) for x in lines], "site string, id int, x1 double, y1 double, x2 double, y2 double")
    cells = spark.createDataFrame([("s", r, c) for r, c in gaps] * 2 + [("t", 0, 0)], "site string, row int, col int")
    got = {r["id"]: r["over"] for r in chords.over_cells(given, cells, ["id"], 8, 8).collect()}
    assert got == {k: any(_passes(*x, r, c) for r, c in gaps) for k, *x in lines}
    assert not got[300] and got[301] and got[302] and got[304] and not got[305] and sum(got.values()) > 50
    passed = chords.passed_cells(given, 8, 8).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in passed} == {k: n for k, *x in lines if (n := sum(_passes(*x, r, c) for r in range(8) for c in range(8)))}


def test_bridges(spark):
    v = spark.createDataFrame([(1, 0, k, float(k), 0.0, k in (0, 3, 4, 7), k in (2, 7)) for k in range(8)], "line_id int, run int, seq int, x double, y double, keep boolean, gap boolean")
    got = chords.bridges(v, ["line_id"], "keep", F.col("gap")).orderBy("seq").collect()
    assert [(r["seq"], r["seq2"], r["bridge"]) for r in got] == [(0, 3, True), (3, 4, False), (4, 7, False)]


def test_every_block_is_recovered(spark):
    """Segments inside a block are found there; those along an edge in the one with their confidence, else in the lower one."""
    rng = np.random.default_rng(8)
    cells = spark.createDataFrame([("s", r, c, float(rng.normal() + r / 4), int(rng.integers(0, 101)), ["measured", "interpolated"][int(rng.random() < 0.3)]) for r in range(15) for c in range(15) if rng.random() < 0.95], "site string, row int, col int, z double, confidence int, coverage string").cache()
    segments = stitching.numbered(contours.segments(cells, 0.7, parts=True))
    got = attribution.source_blocks(segments, cells, ["level", "seg"]).collect()
    assert len(got) > 300
    for r in got:
        assert (r["block_row"], r["block_col"], r["block_confidence"], r["block_prov"], r["alike"]) == (r["row"], r["col"], r["confidence"], r["prov"], True)
    flat = spark.createDataFrame([("s", r, c, 10 * c, "measured") for r in range(3) for c in range(3)], "site string, row int, col int, confidence int, coverage string")
    lone = spark.createDataFrame([("s", k, *x, conf) for k, (*x, conf) in enumerate([(1.5, 0.6, 1.5, 1.4, 10), (1.5, 0.6, 1.5, 1.4, 99), (1.5, 1.5, 1.6, 1.5, 10), (9.0, 9.0, 9.1, 9.0, 1)])], "site string, seg int, x1 double, y1 double, x2 double, y2 double, confidence int")
    got = attribution.source_blocks(lone, flat, ["seg"]).orderBy("seg").collect()
    assert [(r["block_row"], r["block_col"], r["candidates"], r["alike"]) for r in got] == [(0, 1, 2, True), (0, 0, 2, False), (0, 1, 2, True), (None, None, 0, None)]


def _inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def test_points_in_polygons(spark):
    """A square with a hole that holds an island, and a star; points on vertices, edges and level with them."""
    square = [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)], [(2.0, 2.0), (7.0, 2.0), (7.0, 7.0), (2.0, 7.0)], [(4.0, 4.0), (5.0, 4.0), (5.0, 5.0), (4.0, 5.0)]]
    star = [[(5 + (4 if k % 2 else 1.5) * math.cos(k * math.pi / 5), 5 + (4 if k % 2 else 1.5) * math.sin(k * math.pi / 5)) for k in range(10)]]
    units = {"square": square, "star": star}
    edges = [(u, 1, *a, *b) for u, rings in units.items() for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    at = [(x / 2, y / 2) for x in range(-2, 21) for y in range(-2, 21)] + [p for ring in star for p in ring]
    points = [(u, k, float(x), float(y)) for u in units for k, (x, y) in enumerate(at)] + [("square", -1, None, 1.0)]
    p = spark.createDataFrame(points, "unit string, id int, x double, y double")
    e = spark.createDataFrame(edges, "unit string, part int, x1 double, y1 double, x2 double, y2 double")
    for height in (0.7, 100.0):
        got = {(r["unit"], r["id"]) for r in attribution.inside(p, e, ["unit"], ["part"], ["id"], height).collect()}
        assert got == {(u, k) for u, k, x, y in points if x is not None and _inside(x, y, units[u])}
