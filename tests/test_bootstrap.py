"""Draws, replicates and their statistics against a sequential generator and plain lists."""

import math
import re
from collections import Counter
from statistics import median

import duckdb
import numpy as np
import pytest

from tellurion.operators import bootstrap, statistics


def _xorshift(seed):
    s = seed & 0xFFFFFFFF
    while True:
        s ^= (s << 13) & 0xFFFFFFFF
        s ^= s >> 17
        s ^= (s << 5) & 0xFFFFFFFF
        yield s / 4294967296


def _samples(seed, n, replicates):
    g = _xorshift(seed)
    return [[math.floor(next(g) * n) for _ in range(n)] for _ in range(replicates)]


@pytest.mark.parametrize(("n", "replicates"), [(1, 3), (7, 40), (5000, 3)])
def test_draws_are_sequential(spark, n, replicates):
    got = {(r["replicate"], r["number"]): r["times"] for r in bootstrap.draws(spark, 20261109, n, replicates).collect()}
    assert got == {(k, i): t for k, sample in enumerate(_samples(20261109, n, replicates)) for i, t in Counter(sample).items()}


def test_any_step():
    g, s = _xorshift(77), []
    s = [int(next(g) * 4294967296) for _ in range(300)]
    assert bootstrap.advanced(77, np.arange(1, 301)).tolist() == s
    far = bootstrap.advanced(5, np.array([1 << 40]))
    half = bootstrap.advanced(5, np.array([1 << 39]))
    assert bootstrap.advanced(int(half[0]), np.array([1 << 39])) == far and bootstrap.advanced(0, np.array([9]))[0] == 0


def _ranks(v):
    order = sorted(range(len(v)), key=v.__getitem__)
    out = [0.0] * len(v)
    i = 0
    while i < len(v):
        j = i
        while j < len(v) and v[order[j]] == v[order[i]]:
            j += 1
        for k in order[i:j]:
            out[k] = (i + j + 1) / 2
        i = j
    return out


def test_statistics_by_replicate(spark):
    rng, n, replicates = np.random.default_rng(1), 30, 25
    rows = [(k, float(rng.integers(0, 9)), float(rng.integers(1, 9)), int(rng.integers(0, 5)), float(rng.integers(0, 6))) for k in range(n)]
    units = spark.createDataFrame(rows, "id int, top double, bottom double, a int, b double")
    samples = _samples(3, n, replicates)
    got = {r["replicate"]: r for r in bootstrap.ratios(units, "id", {"x": ("top", "bottom", 100.0), "y": ("bottom", "top", 1.0)}, 3, replicates).collect()}
    for k, s in enumerate(samples):
        top, bottom = sum(rows[i][1] for i in s), sum(rows[i][2] for i in s)
        assert got[k]["x"] == pytest.approx(100 * top / bottom) and got[k]["y"] == pytest.approx(bottom / top)
    got = {r["replicate"]: r["mean"] for r in bootstrap.means(units, "id", "top", 3, replicates).collect()}
    assert got == pytest.approx({k: sum(rows[i][1] for i in s) / n for k, s in enumerate(samples)})
    got = {r["replicate"]: r["rho"] for r in bootstrap.correlations(units, "id", "a", "b", 3, replicates).collect()}
    assert got == pytest.approx({k: np.corrcoef(_ranks([rows[i][3] for i in s]), _ranks([rows[i][4] for i in s]))[0, 1] for k, s in enumerate(samples)})
    kept = [(k, float(rng.integers(0, 20))) for k in range(n) for _ in range(int(rng.integers(0, 4)))] + [(0, None)]
    other = [(k, float(rng.integers(0, 20))) for k in range(n) for _ in range(int(rng.integers(0, 4)))]
    k_, o_ = (spark.createDataFrame(x, "id int, v double") for x in (kept, other))
    got = {r["replicate"]: (r["median"], r["share"]) for r in bootstrap.shares_above(units, "id", k_, o_, "v", 3, replicates).collect()}
    for k, s in enumerate(samples):
        m = median(v for i in s for u, v in kept if u == i and v is not None)
        over = [v > m for i in s for u, v in other if u == i]
        assert got[k] == pytest.approx((m, 100 * sum(over) / len(over)))
    assert bootstrap.means(units.limit(0), "id", "top", 3, 5).isEmpty()


def test_weights_merge(spark):
    units = spark.range(2000).selectExpr("id", "id % 7 as a", "1.0 as b").withColumn("null", bootstrap.F.lit(None).cast("double"))
    sums = lambda df: {r["replicate"]: (r["a"], r["b"]) for r in bootstrap.merged_sums(df, "id", ["a", "b", "null"], 4, 300).collect()}
    whole, parts = sums(units.repartition(5)), [sums(units.where("id < 700")), sums(units.where("id >= 700"))]
    assert whole == {k: (parts[0][k][0] + parts[1][k][0], parts[0][k][1] + parts[1][k][1]) for k in range(300)}
    ratio = np.array([a / b for a, b in whole.values()])
    assert abs(ratio.mean() - 2.997) < 0.02 and abs(ratio.std() - 2 / math.sqrt(2000)) < 0.006
    w = bootstrap.poisson_weights(np.arange(20_000), 1, 10)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03


def test_merged_intervals_are_near_those_of_draws(spark):
    from tellurion.plans import bootstraps

    by_draws, merged = (f(spark, "/root/testdata/sf0.01").first().asDict() for f in (bootstraps.paired_bootstrap, bootstraps.merged_bootstrap))
    for name in ("endpoint_fa", "endpoint_wr", "complete_wr"):
        (a, b), (c, d) = ((x[f"{name}_low"], x[f"{name}_high"]) for x in (by_draws, merged))
        assert abs(a - c) < 0.25 * (b - a) and abs(b - d) < 0.25 * (b - a) and 0.8 < (d - c) / (b - a) < 1.25


def _ran(df):
    """The rows, and the plan as it was run."""
    return df.collect(), df._jdf.queryExecution().executedPlan().toString()


def test_ranks_do_not_pass_the_driver(spark):
    """Where a replicate's values are many, so are their ranks: these are merged with the values, however few they are."""
    units = spark.range(500).selectExpr("id", "id * 37 % 101 as a", "id * 53 % 89 / 7 as b")
    rows, plan = _ran(bootstrap.correlations(units, "id", "a", "b", 3, 20))
    assert len(rows) == 20 and all(r["n"] == 500 for r in rows)
    for c in "ab":
        assert re.search(rf"SortMergeJoin \[replicate#\d+, [^\]]*\b{c}#", plan)


def test_draws_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks follow the draws, not the units' few bytes: a task makes and takes no more draws of more units."""
    monkeypatch.setattr(statistics, "DRAWS", 1000, raising=False)
    units = spark.range(300).selectExpr("id", "id % 7 as top", "1 + id % 5 as bottom")
    rows, plan = _ran(statistics.bootstrap_ratio(units, "id", "top", "bottom", 9, 20))
    assert re.search(r"Range \(0, 6000, step=1, splits=6\)", plan) and re.search(r"hashpartitioning\(number#\d+L?, 6\)", plan)
    u = statistics.with_draw(spark.range(6000), 9, bootstrap.F.col("id"), "u").orderBy("id").toPandas()["u"].to_numpy().reshape(20, 300)
    of = np.floor(u * 300).astype(int)
    assert {r["replicate"]: r["ratio"] for r in rows} == pytest.approx(dict(enumerate((of % 7).sum(1) / (1 + of % 5).sum(1))))
    drawn, plan = _ran(bootstrap.replicated(units, "id", 9, 20))
    assert "splits=6" in plan and sum(r["times"] for r in drawn) == 6000
    assert statistics.bootstrap_ratio(units.limit(0), "id", "top", "bottom", 9, 20).isEmpty()


def test_sql_draws_over_many_lines():
    """Beyond 2**24 draws, the SQL's are the generator's as well."""
    from tellurion.plans import bootstraps

    n, r = 90_000, 199
    sql = f"WITH ol AS (SELECT range AS line_id FROM range({n})), {bootstraps._draws('ol')} SELECT number, times FROM dr".replace(f"range({bootstraps.REPLICATES})", f"range({r}, {r + 1})")
    s = bootstrap.advanced(bootstraps.SEED, r * n + 1 + np.arange(n))
    number, times = np.unique(np.floor(s / 4294967296.0 * n).astype(np.int64), return_counts=True)
    assert sorted(duckdb.connect().execute(sql).fetchall()) == list(zip(number.tolist(), times.tolist(), strict=True))
