"""Slope, aspect, levels, reasons for no contours, and simplification by area, against plain restatements."""

import math

import numpy as np
import pytest

from tellurion.operators import contours, ground, match, simplify


def test_derivatives(spark):
    """A plane has one slope and aspect everywhere, along the border too (corners are held along one edge); holes and the border are marked."""
    rows, cols = 11, 13
    hole = (4, 5)
    cells = spark.createDataFrame([("s", r, c, 3.0 * c * 0.5 - 1.0 * r * 2.0) for r in range(rows) for c in range(cols) if (r, c) != hole], "site string, row int, col int, z double")
    for tile in (4, 64):
        got = {(r["row"], r["col"]): r for r in ground.derivatives(cells, rows, cols, (0.5, 2.0), 10.0, tile=tile).collect()}
        assert len(got) == rows * cols - 1
        for (r, c), v in got.items():
            near = max(abs(r - hole[0]), abs(c - hole[1])) == 1
            assert v["synthesised"] == (near or r in (0, rows - 1) or c in (0, cols - 1))
            if not near and not (r in (0, rows - 1) and c in (0, cols - 1)):
                assert v["slope"] == pytest.approx(10 * math.hypot(3, 1)) and v["aspect"] == pytest.approx(math.atan2(1, -3))
    flat = ground.derivatives(spark.createDataFrame([("s", r, c, 1.0) for r in range(3) for c in range(3)], "site string, row int, col int, z double"), 3, 3).collect()
    assert {(r["slope"], r["aspect"]) for r in flat} == {(0.0, 0.0)}


def test_given_levels(spark):
    cells = spark.createDataFrame([("s", r, c, 1.0 * c + 0.1 * r, 50) for r in range(5) for c in range(5)], "site string, row int, col int, z double, confidence int").cache()
    by_step = contours.segments(cells, 0.5).collect()
    levels, spacing = contours.level_list(0.5, 0.0, 4.4)
    assert spacing == 0.5 and sorted(map(tuple, contours.segments(cells, given=levels).collect())) == sorted(map(tuple, by_step))
    assert {r["level"] for r in contours.segments(cells, given=[0.7, 9.0]).collect()} == {0.7} and contours.segments(cells, given=[]).isEmpty()
    assert contours.level_list(given=[3.0, 1.0, 2.0], most=3) == ([1.0, 2.0, 3.0], 1.0) and contours.level_list(given=[0.0, 1.0, 5.0])[1] is None
    assert contours.level_list(given=[float(k) for k in range(9)], most=5) == ([0.0, 2.0, 4.0, 6.0, 8.0], 2.0) and contours.level_list(given=[float(k) for k in range(8)], most=4) == ([0.0, 2.0, 4.0, 7.0], None)


def test_reasons(spark):
    def site(name, z):
        return [(name, k // 2, k % 2, None if v is None else float(v)) for k, v in enumerate(z)]

    rows = site("flat", [2, 2, 2, 2]) + site("between", [2.2, 2.4, 2.6, 2.8]) + site("none", [None] * 4) + site("row", [1, 5]) + site("open", [0, 5, 0, None]) + site("good", [0, 5, 0, 5])
    cells = spark.createDataFrame(rows, "site string, row int, col int, z double")
    got = {r["site"]: r["reason"] for r in contours.no_contours(cells, [1.0, 2.0, 3.0]).collect()}
    assert got == {"flat": "flat surface", "between": "range between levels", "none": "too few covered cells", "row": "too few covered cells", "open": "no cell crosses a level"}
    assert {r["reason"] for r in contours.no_contours(cells.where("site = 'good'"), []).collect()} == {"no levels"}


def _by_area(p, tolerance):
    p = list(enumerate(p))
    while len(p) > 2:
        areas = [abs((a[0] - k[0]) * (b[1] - k[1]) - (b[0] - k[0]) * (a[1] - k[1])) / 2 for (_, a), (_, k), (_, b) in zip(p, p[1:], p[2:], strict=False)]
        least = min(areas)
        if least > tolerance:
            break
        del p[areas.index(least) + 1]
    return [k for k, _ in p]


def test_simplified_by_area(spark):
    """Lines with equal triangles, alone and of two vertices; what is left is matched back to its source."""
    rng = np.random.default_rng(2)
    lines = {k: [(float(x), float(y)) for x, y in zip(np.arange(n), rng.integers(0, 4, n) if k % 2 else rng.normal(0, 2, n), strict=True)] for k, n in enumerate([1, 2, 3, 50, 60, 200, 400])}
    v = spark.createDataFrame([(k, 0, s, x, y) for k, p in lines.items() for s, (x, y) in enumerate(p)], "line_id long, run int, seq long, x double, y double")
    for tolerance in (0.0, 0.8, 100.0):
        kept = simplify.thinned(v, tolerance, {"keep": None}, choose=simplify.by_area).where("keep")
        got = {}
        for r in kept.orderBy("line_id", "seq").collect():
            got.setdefault(r["line_id"], []).append(r["seq"])
        assert got == {k: _by_area(p, tolerance) for k, p in lines.items()}
    back = match.matched(v, kept).where("keep").groupBy("line_id").count().collect()
    assert {r["line_id"]: r["count"] for r in back} == {k: len(s) for k, s in got.items()}
    fixed = np.zeros(5, bool)
    fixed[[0, 2, 4]] = True
    assert simplify.by_area(np.arange(5.0), np.zeros(5), fixed, 1.0).tolist() == [True, False, True, False, True]


def _fewest(x, y, prov, m, tolerance, condition):
    """Every span tried, from every vertex."""
    n = len(x)
    edge = [(prov[k] if prov[k] == prov[k + 1] else "X", *(min((v for v in (c[k], c[k + 1]) if not math.isnan(v)), default=None) for c in m)) for k in range(n - 1)]
    best = [1] + [n + 1] * (n - 1)
    for i in range(n - 1):
        for j in range(i + 1, n):
            e, ends = edge[i:j], (edge[i], edge[j - 1])
            long = math.hypot(x[j] - x[i], y[j] - y[i])
            far = [abs((x[k] - x[i]) * (y[j] - y[i]) - (y[k] - y[i]) * (x[j] - x[i])) / long if long else math.hypot(x[k] - x[i], y[k] - y[i]) for k in range(i + 1, j)]
            ok = max(far, default=0) <= tolerance
            if condition == "exact":
                ok &= len(set(e)) == 1
            elif condition == "safe":
                for c in (1, 2):
                    said = [v[c] for v in ends if v[c] is not None]
                    ok &= not said or min(said) <= min(v[c] for v in e if v[c] is not None) + 1e-12
                kinds = lambda es: {k for v in es for k in ("MI" if v[0] == "X" else v[0])}
                ok &= kinds(e) <= kinds(ends)
            if ok:
                best[j] = min(best[j], best[i] + 1)
    return best[-1]


@pytest.mark.parametrize("condition", simplify.CONDITIONS)
def test_fewest_vertices(condition):
    rng = np.random.default_rng(4)
    for n in (2, 3, 8, 25, 60):
        x, y = np.cumsum(rng.normal(0.5, 1, n)).round(1), np.cumsum(rng.normal(0, 0.6, n)).round(1)
        if n > 20:
            x[10], y[10] = x[3], y[3]
        prov = np.repeat(rng.choice(list("MIX"), n), 3)[:n].astype(object)
        m = [np.where(rng.random(n) < 0.2, np.nan, np.repeat(rng.integers(0, 4, n), 4)[:n] * 25.0) for _ in range(2)]
        ends = np.zeros(n, bool)
        ends[[0, -1]] = True
        for tolerance in (0.0, 0.4, 2.0):
            keep = simplify.fewest(x, y, ends, tolerance, columns={"prov": prov, "m": m[0], "i": m[1]}, condition=condition)
            assert keep.sum() == _fewest(x, y, prov, m, tolerance, condition)
            if condition == "any":
                assert keep.sum() <= simplify.retained(x, y, ends, tolerance).sum()


@pytest.mark.parametrize("condition", simplify.CONDITIONS)
def test_short_pieces_side_by_side(condition, monkeypatch):
    """Many short pieces get the vertices that each gets by itself, ties included."""
    rng, n = np.random.default_rng(6), 3000
    x, y, fixed = np.cumsum(rng.integers(-2, 9, n)).astype(float), rng.integers(0, 60, n).astype(float), rng.random(n) < 0.1
    fixed[[0, -1]] = True
    prov = rng.choice(list("MMMIX"), n).astype(object)
    columns = {"prov": prov, "m": np.where(prov == "I", np.nan, rng.integers(0, 5, n)), "i": np.where(prov == "M", np.nan, rng.integers(0, 5, n))}
    together = simplify.fewest(x, y, fixed, 20.0, columns=columns, condition=condition)
    monkeypatch.setattr(simplify, "SHORT", 0)
    assert (together == simplify.fewest(x, y, fixed, 20.0, columns=columns, condition=condition)).all()


def test_lines_are_read_once_for_all_conditions(spark):
    from tellurion.plans import records

    plan = records.fewest_vertices(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
