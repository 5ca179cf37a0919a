"""Audits of claims on small cases: nulls first and last, one edge, points off the grid, flat blocks, grades."""

import pytest
from pyspark.sql import functions as F

from tellurion.operators import audits


def test_dissolved_lines(spark):
    """The first value is that of the first edge that has one, and a line of one edge isn't scored."""
    rows = [(1, 0, "M", None, None), (1, 1, "M", 50.0, None), (1, 2, "X", 20.0, 9.0), (2, 0, "I", None, 4.0), (3, 0, "M", 5.0, None), (3, 1, "M", 5.0, None), (4, 0, "X", 9.0, 9.0), (4, 1, "I", None, 9.0)]
    e = spark.createDataFrame(rows, "line_id long, seq long, prov string, m double, i double")
    got = {r["line_id"]: r for r in audits.dissolved(e).collect()}
    assert (got[1]["first_m"], got[1]["last_m"], got[1]["mean_m"], got[1]["reference_m"], got[1]["first_prov"], got[1]["reference_prov"]) == (50.0, 20.0, 35.0, 20.0, ["M"], ["I", "M"])
    scores = {r["rule"]: tuple(r)[1:] for r in audits.dissolve_scores(audits.dissolved(e)).collect()}
    assert scores == {"reference": (3, 1, 0, 0), "first": (3, 1, 1, 1), "last": (3, 1, 0, 1), "mean": (3, 1, 1, None)}


def test_sets(spark):
    t = spark.createDataFrame([("X", "M"), ("M", "X"), (None, "I"), ("U", "U")], "got string, truth string")
    assert [r["miss"] for r in t.select(audits.misses(audits.prov_set(F.col("got")), audits.prov_set(F.col("truth"))).alias("miss")).collect()] == [False, True, True, False]
    edges = spark.createDataFrame([(1, 0, "M", 90), (1, 1, "X", 80), (1, 2, "M", 70), (2, 0, "M", 70), (3, 0, "I", 40), (3, 1, "M", 50)], "span long, seq long, prov string, c int")
    grade = F.when(F.min("c") >= 66, "solid").otherwise("dashed")
    got = {r["span"]: (r["grade"], r["grade_loss"], r["typed_loss"]) for r in audits.provenance_losses(edges, ["span"], grade).collect()}
    assert got == {1: ("solid", True, True), 2: ("solid", False, False), 3: ("dashed", True, False)}


def test_checkpoints(spark):
    field = spark.createDataFrame([("s", 0, 0, 1.0, "measured", 80), ("s", 0, 1, float("nan"), "measured", 80)], "site string, row int, col int, z double, coverage string, confidence int")
    points = spark.createDataFrame([("s", 0.5, 0.999, 1.5), ("s", 1.0, 0.0, 1.0), ("s", 0.0, 1.0, 1.0), ("s", -0.001, 0.5, 1.0), ("s", 2.0, 0.5, 1.0), ("s", None, 0.5, 1.0)], "site string, x double, y double, z double")
    got = sorted(((r["channel"], r["error"]) for r in audits.checkpoint_errors(points, field, 2, 2).collect()), key=repr)
    assert got == [("measured", 0.5), *[("off grid", None)] * 3, *[("unsupported", None)] * 2]


def test_uncertainty(spark):
    cells = spark.createDataFrame([("s", r, c, 2.0 * c if r < 2 else 0.0, 0.1 + 0.1 * r) for r in range(4) for c in range(2)], "site string, row int, col int, z double, se double")
    got = {r["row"]: (r["u"], r["steep"]) for r in audits.block_uncertainty(cells).collect()}
    assert got[0] == (pytest.approx(0.2 / 2), True) and got[2] == (pytest.approx(0.4 / 0.05), False)
    edges = spark.createDataFrame([("s", 1, k, 1.0, u, True) for k, u in enumerate([1.0, 4.0, 2.0])] + [("s", 2, 0, 5.0, 3.0, False)] + [("s", 3, k, 1.0, u, True) for k, u in enumerate([1.0, 3.0, 1.0])], "site string, span int, seq int, len double, u double, steep boolean")
    r = audits.understatement(audits.understated(edges, ["span"])).first()
    assert (r["length"], r["under_length"], r["spans"], r["steep_length"], r["factor_middle"], r["factor_most"], r["more_middle"], r["more_most"]) == (11.0, 6.0, 2, 6.0, 3.0, 3.0, 2.0, 2.0)


def test_compared_results(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5.0), (3, 3.0, None), (4, 4.0, 1.0)], "k int, v double, w double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, None), (2, 2.0, 5.5), (3, 3.0, 0.0), (5, 5.0, 1.0)], "k int, v double, w double")
    got = {r["k"]: (r["state"], r["w"]) for r in audits.compared(a, b, ["k"], ["v", "w"]).collect()}
    assert got == {1: ("same", None), 2: ("differs", 0.5), 3: ("differs", None), 4: ("left only", None), 5: ("right only", None)}


def test_worst_and_targets(spark):
    from tellurion.operators import grid

    t = spark.createDataFrame([("b", 5.0, 1.0), ("a", 5.0, 1.0), ("c", 5.0, 2.0), ("d", 9.0, 0.5), ("e", 0.0, 9.0)], "site string, more double, len double")
    assert [r["site"] for r in audits.worst(t, "more", "len", ["site"], 9).collect()] == ["d", "c", "a", "b"]
    cells = spark.createDataFrame([("s", 1), ("s", 3), ("t", 8)], "site string, n long")
    targets = {k: {r["site"]: r["target"] for r in grid.support(cells, **o).collect()} for k, o in (("own", {}), ("shared", {"shared": True}), ("given", {"target": 6}))}
    assert targets == {"own": {"s": 2.0, "t": 8.0}, "shared": {"s": 3.0, "t": 3.0}, "given": {"s": 6.0, "t": 6.0}}


def test_hidden_errors(spark):
    """An edge between the ends that is weaker than both is hidden; blocks take the errors that they have."""
    rows = [(1, 0, 80, 1.0), (1, 1, 40, 3.0), (1, 2, 90, None), (2, 0, 70, 2.0), (2, 1, 75, 1.0), (3, 0, 50, None), (4, 0, 70, None), (4, 1, 10, None), (4, 2, 70, 0.5)]
    e = spark.createDataFrame([("s", *r) for r in rows], "site string, span int, seq int, confidence int, error double")
    got = {r["span"]: tuple(r)[2:] for r in audits.hidden_errors(e, ["span"], 66).collect()}
    assert got == {1: (True, 3.0, 1.0, 3.0, True, False), 2: (False, None, 1.5, 2.0, True, True), 3: (False, None, None, None, False, False), 4: (True, None, 0.5, 0.5, True, False)}
    cells = spark.createDataFrame([("s", 0, 0, 3.0), ("s", 0, 1, None), ("s", 1, 0, 4.0), ("s", 1, 1, None), ("s", 0, 2, None), ("s", 1, 2, None)], "site string, row int, col int, error double")
    assert {r["col"]: r["error"] for r in audits.block_errors(cells).collect()} == {0: pytest.approx((25 / 2) ** 0.5), 1: None}
