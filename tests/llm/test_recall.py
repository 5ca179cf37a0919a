"""The traversal's recall against brute force, on vectors all over the sphere and on vectors in groups."""

import numpy as np
import pytest

from tellurion.llm import ann


@pytest.mark.parametrize("grouped", [False, True])
def test_recall(spark, grouped, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 16))
    if grouped:
        x = 4 * rng.normal(size=(60, 16))[rng.integers(0, 60, 6000)] + x
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    monkeypatch.setattr(ann, "SAMPLE", 1500)
    monkeypatch.setattr(ann, "ENTRIES", 500)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(table, ann.F.col("vec_id") % 20 == 0, exact=False).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    y, hits = x.astype(float), 0
    assert sorted(got) == list(range(0, 6000, 20))
    for i, found in got.items():
        score = y @ y[i]
        score[i] = -np.inf
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        assert [f[2] for f in found] == pytest.approx([score[f[1]] for f in found], abs=1e-12)
        hits += len(set(np.argsort(-score, kind="stable")[:20].tolist()) & {f[1] for f in found})
    assert hits / (20 * len(got)) >= 0.93


def test_share_is_small_where_vectors_lie_in_groups():
    rng = np.random.default_rng(4)
    shares = []
    for spread in (0.0, 6.0):
        x = rng.normal(size=(3000, 16)) + spread * rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)]
        one, two = ann.codebook(x[:, :8], 16), ann.codebook(x[:, 8:], 16)
        cell = ann.nearest(x[:, :8], one) * len(two) + ann.nearest(x[:, 8:], two)
        sums = ((x[:200, :8] @ one.T)[:, :, None] + (x[:200, 8:] @ two.T)[:, None]).reshape(200, -1)
        shares.append(ann.measured_share(x, cell, sums, 20))
    assert shares[1] < 0.2 < shares[0] <= 1
