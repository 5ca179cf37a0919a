"""The evidence meet and records against plain restatements: algebra, composition, wrapped records, simplification."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.operators import evidence, meet, simplify

CHANNELS = ["a", "b"]
SCHEMA = "id long, provenance array<string>, " + ", ".join(f"{c} {meet.CHANNEL}" for c in CHANNELS) + ", lineage array<string>"


def _plain(records):
    """The meet by its rules: (provenance, {channel: (state, value, scope)}, lineage)."""
    out = {}
    for c in CHANNELS:
        of = [r[c] for r in records]
        applies = [x for x in of if (x[0] if x[0] is not None else x[2] or x[1] is not None)]
        scopes = [set(x[3]) for x in applies if x[3] is not None]
        common = set.intersection(*scopes) if scopes else None
        if not applies:
            out[c] = ("not_applicable", None, None)
        elif any(x[1] is None for x in applies) or any(x[2] for x in of) or common == set():
            out[c] = ("unavailable", None, None)
        else:
            out[c] = ("value", min(x[1] for x in applies), None if common is None else frozenset(common))
    prov = [p for p in meet.PROVENANCE if any(p in (r["provenance"] or ()) for r in records)]
    return prov, out, sorted({x for r in records for x in r["lineage"] or ()})


def _read(df):
    got = {}
    for r in df.select("id", "provenance", "lineage", *CHANNELS, *(meet.state(c).alias(f"{c}_state") for c in CHANNELS)).collect():
        got[r["id"]] = (r["provenance"], {c: (r[f"{c}_state"], r[c]["value"], None if r[c]["scope"] is None else frozenset(r[c]["scope"])) for c in CHANNELS}, r["lineage"])
    return got


def _random_records(rng, n):
    def one():
        kind = rng.choice(["value", "missing", "inapplicable", "undeclared", "none"])
        scope = None if rng.random() < 0.6 else rng.sample(["bare", "forest", "urban"], rng.randint(1, 3))
        return {"value": (True, round(rng.random(), 3), False, scope), "missing": (True, None, False, scope), "inapplicable": (False, None, False, None), "undeclared": (None, round(rng.random(), 3), False, scope), "none": (None, None, False, None)}[kind]

    return [{"provenance": rng.sample(list(meet.PROVENANCE), rng.randint(1, 2)), "lineage": rng.sample("pqrs", rng.randint(0, 3)), **{c: one() for c in CHANNELS}} for _ in range(n)]


def test_meet_and_composition(spark):
    rng, rows, want = random.Random(5), [], {}
    for i in range(400):
        records = _random_records(rng, rng.randint(2, 9))
        want[i] = _plain(records)
        rows += [(i, r["provenance"], r["a"], r["b"], r["lineage"], rng.randint(0, 2)) for r in records]
    df = spark.createDataFrame(rows, SCHEMA + ", part int")
    assert _read(meet.meet(df, ["id"], CHANNELS)) == want
    assert _read(meet.meet(meet.meet(df, ["id", "part"], CHANNELS), ["id"], CHANNELS)) == want
    forgetful = meet.meet(df, ["id", "part"], CHANNELS).withColumns({c: F.struct(F.lit(None).cast("boolean").alias("applicable"), F.col(f"{c}.value").alias("value"), F.lit(False).alias("unavailable"), F.col(f"{c}.scope").alias("scope")) for c in CHANNELS})
    assert _read(meet.meet(forgetful, ["id"], CHANNELS)) != want


def test_meet_cases(spark):
    none = (False, None, False, None)
    cases = {
        1: [(["measured"], (True, 0.72, False, None), none, ["t2", "t1"]), (["interpolated"], none, (True, 0.41, False, None), ["t1", "t3"])],
        2: [(["measured"], (True, 0.93, False, None), none, None), (["measured"], (True, 0.18, False, None), none, None), (["measured"], (True, 0.93, False, None), none, None)],
        3: [(["measured"], (True, 0.8, False, None), none, None), (["measured"], (True, None, False, None), none, None)],
        4: [(["measured"], (True, 0.7, False, ["bare", "forest"]), none, None), (["measured"], (True, 0.5, False, ["bare"]), none, None)],
        5: [(["measured"], (True, 0.7, False, ["bare"]), none, None), (["measured"], (True, 0.5, False, ["urban"]), none, None)],
        6: [(None, (None, 0.4, False, None), (None, None, True, None), None)],
    }
    got = _read(meet.meet(spark.createDataFrame([(i, *r) for i, rs in cases.items() for r in rs], SCHEMA), ["id"], CHANNELS))
    assert got[1] == (["measured", "interpolated"], {"a": ("value", 0.72, None), "b": ("value", 0.41, None)}, ["t1", "t2", "t3"])
    assert got[2][1]["a"] == ("value", 0.18, None) and got[3][1]["a"] == ("unavailable", None, None)
    assert got[4][1]["a"] == ("value", 0.5, frozenset({"bare"})) and got[5][1]["a"][0] == "unavailable"
    assert got[6] == ([], {"a": ("value", 0.4, None), "b": ("unavailable", None, None)}, [])
    assert meet.meet(spark.createDataFrame([], SCHEMA), ["id"], CHANNELS).isEmpty()
    with pytest.raises(Exception, match="out of range"):
        meet.validated(spark.createDataFrame([(1, [], (True, 1.5, False, None), none, [])], SCHEMA), CHANNELS).collect()
    corners = spark.createDataFrame([(k, ["measured"] if k != 9 else [], (True, 0.5, False, None), none, []) for k in (1, 1, 1, 1, 2, 2, 2, 9, 9, 9, 9)], SCHEMA)
    assert [r["id"] for r in meet.corner_meet(corners, ["id"], CHANNELS).collect()] == [1]


def _edges(spark, rows):
    return spark.createDataFrame([(1, k, k, 1.0, *r) for k, r in enumerate(rows)], "line_id long, seq long, run long, len double, prov string, m double, i double")


def test_wrapped_records(spark):
    e = _edges(spark, [("M", 90.0, None), ("M", 20.0, None), ("X", 80.0, 60.0), ("I", None, 70.0), ("M", 90.0, None), ("M", None, None), ("X", 70.0, 50.0), ("M", 65.96, None)]).withColumn("span", F.element_at(F.array(*map(F.lit, (0, 0, 1, 1, 2, 2, 2, 3))), (F.col("seq") + 1).cast("int")))
    got = {r["span"]: r for r in evidence.wrapped(evidence.profiles(e, ["line_id", "span"])).collect()}
    assert (got[0]["prov"], got[0]["m_min"], got[0]["i_state"], got[0]["m_ge66"]) == ("M", 20.0, "not_applicable", 0.5)
    assert (got[1]["prov"], got[1]["m_min"], got[1]["i_min"]) == ("I|M", 80.0, 60.0)
    assert (got[2]["m_state"], got[2]["m_min"], got[2]["i_state"], got[2]["i_min"]) == ("unavailable", None, "value", 50.0)
    assert got[3]["m_min"] == 65.96 and got[3]["m_ge66"] == 0
    parts = evidence.profiles(e, ["line_id", "span"])
    assert evidence.merged(parts, ["line_id"]).exceptAll(evidence.profiles(e, ["line_id"]).select(evidence.merged(parts, ["line_id"]).columns)).isEmpty()


def _recursive(p, fixed, tolerance, clamped):
    def far(a, b, k):
        (ax, ay), (bx, by), (x, y) = p[a], p[b], p[k]
        square = (bx - ax) ** 2 + (by - ay) ** 2
        if not square:
            return math.hypot(x - ax, y - ay)
        if clamped:
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / square))
            return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))
        return abs((x - ax) * (by - ay) - (y - ay) * (bx - ax)) / math.sqrt(square)

    def rec(a, b):
        d = [far(a, b, k) for k in range(a + 1, b)]
        if not d or max(d) <= tolerance:
            return {a, b}
        k = a + 1 + d.index(max(d))
        return rec(a, k) | rec(k, b)

    at = [k for k, f in enumerate(fixed) if f]
    return set().union({at[0]}, *(rec(a, b) for a, b in zip(at, at[1:], strict=False)))


@pytest.mark.parametrize("clamped", [False, True])
def test_retained_matches_recursion(clamped):
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        x, y = rng.integers(0, 12, n).astype(float), rng.normal(size=n) * 4
        fixed = rng.random(n) < 0.1
        fixed[[0, -1]] = True
        got = simplify.retained(x, y, fixed, 2.0, clamped)
        assert set(np.nonzero(got)[0].tolist()) == _recursive(list(zip(x.tolist(), y.tolist(), strict=True)), fixed.tolist(), 2.0, clamped)


def test_gap_and_batches(spark, monkeypatch):
    """No chord touches an unsupported vertex, and where batches end changes nothing."""
    rows = [(1, k, float(k), 0.001 * (k == 2), "U" if k == 3 else "M", 90.0, None) for k in range(7)]
    v = spark.createDataFrame(rows, "line_id long, seq long, x double, y double, prov string, m double, i double")
    assert [r["seq"] for r in simplify.simplified(v, 0.5).where("keep").orderBy("seq").collect()] == [0, 2, 4, 6]
    big = spark.range(40_000).select(F.expr("id div 7000 AS line_id"), F.expr("id % 7000 AS seq"), F.col("id").cast("double").alias("x"), F.sin(F.col("id") / 50).alias("y"), F.when(F.col("id") % 997 == 5, "U").otherwise("M").alias("prov"), F.lit(1.0).alias("m"), F.lit(None).cast("double").alias("i"))
    out = simplify.simplified(big, 0.01)
    assert out.count() == big.where("prov <> 'U'").count()
    for line in (0, 5):
        mine = out.where(F.col("line_id") == line).orderBy("seq").collect()
        for run in {r["run"] for r in mine}:
            part = [r for r in mine if r["run"] == run]
            fixed = [k in (0, len(part) - 1) for k in range(len(part))]
            assert {k for k, r in enumerate(part) if r["keep"]} == _recursive([(r["x"], r["y"]) for r in part], fixed, 0.01, False)
    assert simplify.simplified(v.limit(0), 1.0).isEmpty()


def test_forced_vertices(spark):
    rows = [(1, k, float(k), 0.0, "M", m, None) for k, m in enumerate([90.0, 90.0, 20.0, 20.0, 90.0])]
    v = spark.createDataFrame(rows, "line_id long, seq long, x double, y double, prov string, m double, i double")
    placed = simplify.with_boundaries(simplify.stretches(v), {"p": ("prov",), "b": ("band",), "w": ("bin", 0)})
    kept = simplify.thinned(placed, 1.0, {"dp": None, "band": F.col("b"), "exact": F.col("w")})
    assert [(r["dp"], r["band"], r["exact"]) for r in kept.orderBy("seq").collect()] == [(True,) * 3, (False, True, True), (False,) * 3, (False,) * 3, (True,) * 3]
    scored = evidence.scores(evidence.carried(simplify.edges_within(kept, "dp").withColumnRenamed("dp", "span"), "endpoint"), []).first()
    assert (scored["spans"], scored["promoted"], scored["provenance_loss"]) == (1, 0, 0)


def test_methods_compared_on_single_rows(spark):
    """The totals of scores by method, without a copy of the edges a method or a group of a span."""
    rng = random.Random(8)
    rows = []
    for line in range(40):
        a = b = 0
        for seq in range(rng.randint(1, 25)):
            a, b, prov = a + (rng.random() < 0.3), b + (rng.random() < 0.5), rng.choice("MIX")
            rows.append((line, seq, rng.random(), prov, rng.randint(0, 99) / 1.0 if prov != "I" else None, rng.randint(0, 99) / 1.0 if prov != "M" else None, a, b))
    edges = spark.createDataFrame(rows, "line_id long, seq long, len double, prov string, m double, i double, a int, b int")
    methods = {f"{k}-{rule}": (k, rule) for k in "ab" for rule in evidence.RULES}
    found = evidence.compared(edges, methods)
    got = {r["method"]: r.asDict() for r in found.collect()}
    for name, (k, rule) in methods.items():
        cut = edges.withColumn("span", F.col(k)).withColumn("method", F.lit(name))
        want = evidence.scores(evidence.carried(cut, rule, ("method", "line_id", "span")), ["method"]).first().asDict()
        assert {c: v for c, v in got[name].items() if c != "method"} == pytest.approx({c: v for c, v in want.items() if c != "method"})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(got) == 6 and "Expand" not in plan and plan.count("Generate explode") == 1 and plan.count("Aggregate") == 1
    assert evidence.compared(edges.limit(0), methods).isEmpty()
