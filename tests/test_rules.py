"""Small rules on points, levels, runs, rings and profiles."""

import math

import pytest
from pyspark.sql import functions as F

from tellurion.operators import contours, fill, grid, predicates, profiles


def test_levels():
    assert contours.level_list(1.0, 0.2, 3.0) == ([1.0, 2.0, 3.0], 1.0)
    assert contours.level_list(0.1, 0.0, 0.3)[0] == pytest.approx([0.0, 0.1, 0.2, 0.3])
    levels, spacing = contours.level_list(1.0, 0.0, 500.0)
    assert len(levels) <= 200 and levels[0] == 0 and levels[-1] == 500 and spacing == 3.0
    assert contours.level_list(given=[3.0, 1.0, 2.0]) == ([1.0, 2.0, 3.0], 1.0) and contours.level_list(given=[1.0, 2.0, 4.0]) == ([1.0, 2.0, 4.0], None)
    assert contours.level_list(1.0, 0.2, 0.8) == ([], 1.0)


def test_runs_and_rings(spark):
    v = spark.createDataFrame([(1, k, float(k), 0.0, c) for k, c in enumerate([90, 80, 40, 50, 70, 99])], "line_id long, seq long, x double, y double, confidence int")
    got = contours.feature_runs(v, grid.grade).orderBy("seq").collect()
    assert [(r["seq"], r["run"], r["grade"]) for r in got] == [(0, 1, "solid"), (1, 2, "dashed"), (2, 2, "dashed"), (3, 2, "dashed"), (4, 3, "solid")]
    ring = [(math.cos(k / 16 * math.pi), math.sin(k / 16 * math.pi)) for k in range(32)]
    turns = [(n, k, *ring[(k + n) % 32]) for n in range(32) for k in range(32)]
    lines = {}
    for r in contours.anchored_rings(spark.createDataFrame(turns, "line_id long, seq long, x double, y double")).orderBy("line_id", "seq").collect():
        lines.setdefault(r["line_id"], []).append((r["seq"], r["x"], r["y"]))
    assert len(lines[0]) == 33 and lines[0][0][1:] == lines[0][32][1:] == min(ring) and all(x == lines[0] for x in lines.values())


def test_saddles_and_level_slack(spark):
    """A level that rounding puts above the corner still meets it; a twisted block at its saddle joins the high corners."""
    def segments(z, interval):
        rows = [("s", r, c, h, 50) for (r, c), h in zip(contours.CORNERS, z, strict=True)]
        return contours.segments(spark.createDataFrame(rows, "site string, row int, col int, z double, confidence int"), interval).collect()

    assert {round(r["level"], 9) for r in segments([0.0, 0.1, 0.3, 0.2], 0.1)} >= {0.1, 0.2}
    high = segments([1.0, 0.0, 1.0, 0.0], 0.5)
    assert len([r for r in high if r["level"] == 0.5]) == 2


def test_small_rules(spark):
    one = spark.range(1)

    def of(column):
        return one.select(column.alias("v")).first()["v"]

    lit = lambda x: F.lit(x).cast("double")
    assert [of(predicates.mask_class(lit(z), lit(e), F.lit(m))) for z, e, m in ((1, 0.5, 1), (1, 0.5, 0), (None, 0.5, 1), (1, -32767, 1), (1, 0.5, 3), (float("nan"), 1, 1))] == ["measured", "void", "void", "edited", "edited", "void"]
    assert [of(predicates.vertical_unit(lit(m), lit(r))) for m, r in ((100, 101), (1000, 305), (10, 6), (None, 3))] == ["metre", "foot", None, None]
    assert [of(predicates.utm_zone(lit(x), lit(y))) for x, y in ((-180, 10), (179.9, -1), (9, 0))] == [32601, 32760, 32632]
    east, north = predicates.cell_metres(lit(1), lit(60))
    assert of(east) == pytest.approx(55_660) and of(north) == 111_320 and of(predicates.cell_metres(lit(1), lit(None))[0]) == 111_320
    assert of(predicates.cell_metres(lit(1), lit(90))[0]) == pytest.approx(111_320 * math.cos(math.radians(89)))
    assert [of(predicates.nominal_cell(lit(a), lit(n))) for a, n in ((10_000, 40_000), (10_000, 2_500), (10_000, 2_000))] == [1, 2, 3]
    points = spark.createDataFrame([(1.0, 2.0, 3.0, True), (11.0, 2.0, 3.0, None)], "x double, y double, z double, is_ground boolean")
    assert predicates.ground_only(points).count() == 1 and predicates.upright(points, "y").first()["z"] == 2.0
    assert [r["x"] for r in predicates.cropped(points, F.lit(1), F.lit(0), 10).collect()] == [0.0]
    crops = predicates.crop_origins(spark.createDataFrame([(0.0, 401.0, 0.0, 400.0)], "x0 double, x1 double, y0 double, y1 double")).collect()
    assert [(r["ox"], r["oy"]) for r in crops[:4]] == [(50, 50), (150, 50), (250, 50), (50, 150)]
    field = spark.createDataFrame([("a", 1.0, "measured", 50.0), ("a", None, "measured", 50.0), ("b", None, None, 101.0), ("c", 1.0, "measured", 0.0)], "site string, z double, coverage string, confidence double")
    assert {r["site"]: r["cells"] for r in predicates.dishonest_cells(field).collect()} == {"a": 1, "b": 1}
    lines = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "line_id long, seq long")
    assert predicates.eligible(lines, 3).count() == 3


def test_profiles(spark):
    rows = [("s", 0, c, n, 1.0, cov, d, 0.0, 0) for c, (n, cov, d) in enumerate([(1, "measured", 0), (4, "measured", 0), (0, "interpolated", 1), (0, "interpolated", 3)])]
    field = spark.createDataFrame(rows, "site string, row int, col int, n long, z double, coverage string, dist int, slope double, confidence int")
    got = [r["confidence"] for r in profiles.exponential(field).orderBy("col").collect()]
    assert got == [round(100 * (1 - math.exp(-0.5))), round(100 * (1 - math.exp(-2))), 50, round(50 * math.exp(-2 / 1.5))]
    points = spark.createDataFrame([("s", 0, 0, 1.0), *[("s", 0, 1, z) for z in (1.0, 1.1, 0.9, 1.0)]], "site string, row int, col int, z double")
    errors = {r["col"]: r["se"] for r in profiles.standard_errors(points).collect()}
    assert errors[0] == pytest.approx(0.05) and errors[1] == pytest.approx(math.sqrt((0.02 / 3 + 0.0025) / 4))
    survey = [r["confidence"] for r in profiles.survey(field, profiles.standard_errors(points)).orderBy("col").collect()]
    worst = max(errors.values())
    assert survey[:2] == [round(100 * math.exp(-(errors[c] ** 2) / 0.02)) for c in (0, 1)]
    assert survey[2:] == [math.floor(100 * math.exp(-(worst**2 + (0.05 * d) ** 2) / 0.02) + 0.5) for d in (1, 3)]
    assert fill.SCHEMA.startswith("site")
