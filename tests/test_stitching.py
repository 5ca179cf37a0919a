"""Stitched lines against a plain walk, for any tile; records carried to edges."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tellurion.operators import contours, stitching


def _plain(rows):
    """Lines of (site, level, seg, x1, y1, x2, y2, confidence): ends paired by segment at every point, each line from its first segment."""
    lines = {}
    groups = defaultdict(list)
    for r in rows:
        groups[r[:2]].append(r[2:])
    for group, segs in groups.items():
        key = lambda x, y: (math.floor(x * 1000 + 0.5), math.floor(y * 1000 + 0.5))
        segs = sorted(s for s in segs if key(s[1], s[2]) != key(s[3], s[4]))
        at = defaultdict(list)
        for s in segs:
            for end in (0, 1):
                at[key(*s[1 + 2 * end : 3 + 2 * end])].append((s[0], end))
        joined = {}
        for ends in at.values():
            ends.sort()
            for a, b in zip(ends[::2], ends[1::2], strict=False):
                joined[a], joined[b] = b, a
        seen = set()
        for s in segs:
            if s[0] in seen:
                continue
            chain, closed, end = [(s[0], True)], False, (s[0], 1)
            while end in joined:
                k, e = joined[end]
                if k == s[0]:
                    closed = True
                    break
                chain.append((k, e == 0))
                end = (k, 1 - e)
            end = (s[0], 0)
            while not closed and end in joined:
                k, e = joined[end]
                chain.insert(0, (k, e == 1))
                end = (k, 1 - e)
            seen |= {k for k, _ in chain}
            for place, (k, ahead) in enumerate(chain):
                lines[(*group, k)] = (s[0], place, ahead, closed and len(chain) > 2)
    return lines


def _grid(rng, rows, cols, whole):
    z = rng.integers(0, 4, (rows, cols)).astype(float) if whole else np.cumsum(np.cumsum(rng.normal(size=(rows, cols)), 0), 1) / 20
    return [("s", r, c, float(z[r, c]), int(rng.integers(0, 101))) for r in range(rows) for c in range(cols) if rng.random() > 0.03]


@pytest.mark.parametrize("whole", [False, True])
def test_lines(spark, whole):
    """Smooth heights with long lines and rings, and whole ones, where many segments meet in one point."""
    cells = spark.createDataFrame(_grid(np.random.default_rng(int(whole)), 40, 40, whole), "site string, row int, col int, z double, confidence int")
    segments = stitching.numbered(contours.segments(cells, 1.0, parts=True)).cache()
    rows = [tuple(r) for r in segments.select("site", "level", "seg", "x1", "y1", "x2", "y2", "confidence").collect()]
    want = _plain(rows)
    assert len(want) > 300 and any(x[3] for x in want.values())
    given = {r[:3]: r for r in rows}
    for tile in (4, 16, 64):
        got = {}
        for r in stitching.stitched(segments, tile=tile).collect():
            k = (r["site"], r["level"], r["seg"])
            ahead = (r["x1"], r["y1"], r["x2"], r["y2"]) == given[k][3:7]
            assert ahead or (r["x2"], r["y2"], r["x1"], r["y1"]) == given[k][3:7]
            got[k] = (r["line"], r["place"], ahead, r["closed"])
        assert got == want


def test_vertices_and_records(spark):
    """A ring over four blocks and an open line; the lesser support where segments meet; records matched either way round."""
    ring = [(0, 0, 0, 1.0, 0.0, 0.0, 1.0, 90), (1, 1, 0, 0.0, 1.0, 1.0, 2.0, 20), (2, 1, 1, 1.0, 2.0, 2.0, 1.0, 50), (3, 0, 1, 2.0, 1.0, 1.0, 0.0, 70)]
    line = [(4, 5, 5, 8.0, 5.0, 7.0, 5.0, 10), (5, 5, 6, 8.0, 5.0000001, 9.0, 5.0, 30)]
    rows = [("s", 1.0, *r) for r in ring + line] + [("s", 1.0, 9, 7, 7, 7.0, 7.0, 7.0, 7.0001, 5)]
    edges = stitching.stitched(spark.createDataFrame(rows, "site string, level double, seg long, row int, col int, x1 double, y1 double, x2 double, y2 double, confidence int"), tile=1)
    v = [tuple(r)[2:] for r in stitching.line_vertices(edges).orderBy("line", "seq").collect()]
    assert v == [(0, 0, 1.0, 0.0, 70, True), (0, 1, 0.0, 1.0, 20, True), (0, 2, 1.0, 2.0, 20, True), (0, 3, 2.0, 1.0, 50, True),
                 (4, 0, 9.0, 5.0, 30, False), (4, 1, 8.0, 5.0, 10, False), (4, 2, 7.0, 5.0, 10, False)]
    records = spark.createDataFrame([("s", 1.0, 1.0, 0.0, 0.0, 1.0, 1, "a"), ("s", 1.0, 9.0, 5.0, 8.0, 5.0, 2, "b"), ("s", 1.0, 9.0, 5.0, 8.0, 5.0, 3, "c")], "site string, level double, x1 double, y1 double, x2 double, y2 double, n int, prov string")
    assert [r["prov"] for r in stitching.with_records(edges, records).orderBy("seg").collect()] == ["a", None, None, None, None, "b"]
    assert stitching.stitched(edges.drop("line", "place", "closed").limit(0)).isEmpty()
