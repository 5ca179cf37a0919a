"""Adversarial lines: how often simplification promotes support by its ends, at given tolerances, and what gaps do to it."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tellurion.operators import simplify

#: Tolerance, segments and promoted segments of the 2,000 lines.
COUNTS = ((0.02, 26591, 14687), (0.05, 13004, 9830), (0.10, 9469, 7678), (0.20, 5459, 4650), (0.40, 2000, 2000))


def _draws(seed):
    mask = 0xFFFFFFFF
    while True:
        seed = (seed + 0x6D2B79F5) & mask
        t = ((seed ^ seed >> 15) * (seed | 1)) & mask
        t = ((t + (((t ^ t >> 7) * (t | 61)) & mask)) & mask) ^ t
        yield ((t ^ t >> 14) & mask) / 4294967296


def _line(seed, n):
    """A noisy sine of ``n`` vertices with one to four weak ones inside."""
    u = _draws(seed)
    amp, freq, phase = 0.01 + 0.18 * next(u), 0.7 + 2.3 * next(u), 6.283185307 * next(u)
    x, y, s = [], [], []
    for i in range(n):
        x.append(i / (n - 1) * 10)
        y.append(amp * math.sin(freq * x[-1] + phase) + 0.005 * (next(u) - 0.5))
        s.append(0.78 + 0.2 * next(u))
    for _ in range(1 + math.floor(4 * next(u))):
        at = 2 + math.floor((n - 4) * next(u))
        s[at] = 0.08 + 0.42 * next(u)
    return x, y, s


def _table(spark, lines, gaps=()):
    parts = [pd.DataFrame({"line_id": k, "seq": np.arange(len(x)), "x": x, "y": y, "m": s}) for k, (x, y, s) in enumerate(lines)]
    t = pd.concat(parts)
    t["prov"] = "M"
    for k, i in gaps:
        t.loc[(t["line_id"] == k) & (t["seq"] == i), "prov"] = "U"
    return spark.createDataFrame(t).withColumn("i", F.lit(None).cast("double"))


@pytest.fixture(scope="module")
def lines(spark):
    return _table(spark, [_line(0xC0FFEE + s, 64) for s in range(1, 2001)]).cache()


@pytest.mark.parametrize(("tolerance", "segments", "promoted"), COUNTS)
def test_promotions(lines, tolerance, segments, promoted):
    kept = simplify.thinned(simplify.stretches(lines), tolerance, {"keep": None}, clamped=True).select("line_id", "seq", "m", "keep").toPandas().sort_values(["line_id", "seq"])
    m, at = kept["m"].to_numpy().reshape(-1, 64), kept["keep"].to_numpy().reshape(-1, 64)
    found = up = 0
    for support, keep in zip(m, at, strict=True):
        ends = np.nonzero(keep)[0]
        for a, b in zip(ends, ends[1:], strict=False):
            found += 1
            up += min(support[a], support[b]) - support[a : b + 1].min() > 1e-12
    assert (found, up) == (segments, promoted)


def test_gaps(spark):
    drawn, gaps = [_line(0xBAD5EED + s, 48) for s in range(1, 1001)], [(s - 1, 10 + s % 28) for s in range(1, 1001)]

    def bridges(table):
        kept = simplify.thinned(simplify.stretches(table), 0.25, {"keep": None}, clamped=True).where("keep").select("line_id", "run", "seq").toPandas().sort_values(["line_id", "seq"])
        total = 0
        for k, i in gaps:
            mine = kept[kept["line_id"] == k]
            for _, part in mine.groupby("run"):
                s = part["seq"].to_numpy()
                total += int(((s[:-1] < i) & (s[1:] > i)).sum())
        return total

    assert bridges(_table(spark, drawn)) == 970
    assert bridges(_table(spark, drawn, gaps)) == 0
