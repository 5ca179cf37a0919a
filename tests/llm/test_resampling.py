"""Importance resampling against a plain restatement, with odd inputs, any head and pairs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tellurion.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text, most):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def _want(docs, target, most, buckets, share, least):
    raw, aim = Counter(), Counter()
    for counter, texts in ((raw, [t for _, t in docs]), (aim, target)):
        for t in texts:
            counter.update(zlib.crc32(f.encode()) % buckets for f in _features(t, most)[1])
    s, t = sum(raw.values()) + buckets, sum(aim.values()) + buckets
    gain = [math.floor(1000 * math.log((aim[b] + 1) * s / ((raw[b] + 1) * t))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        w, f = _features(text, most)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(w), len(f), weight, score, None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (r[4] is None, -(r[4] or 0), r[0] or 0))
    for k, r in enumerate(fit[: share[0] * len(fit) // share[1]]):
        r[5] = k + 1
    return rows


def _docs():
    rng = np.random.default_rng(5)
    vocab = ["The", "of", "naïve", "x1", "ДОМ", "long" * 40, *(f"w{i}" for i in range(200))]
    texts = [" ".join(rng.choice(vocab, int(n), p=np.r_[[0.1] * 5, 0.01, [0.49 / 200] * 200])) for n in rng.integers(0, 60, 150)]
    texts += [None, "", " \n", "one", "a,b.c'd  E\x7fF", "big " * 30_000]
    return [(i * 3 % 500, t) for i, t in enumerate(texts)] + [(7_000, texts[0])] * 3 + [(None, texts[1] + " the" * 25)]


@pytest.mark.parametrize("most", [1, 2])
def test_resampling(spark, most, monkeypatch):
    docs, target = _docs(), ["the of the of x1", None, "ДОМ w1 w2 w3, W4"]
    given = spark.createDataFrame([(*d, 1, "s", "r") for d in docs], "doc_id long, text string, weight int, score string, rank string").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for limit in (1 << 16, 20):
        monkeypatch.setattr(resampling, "HEAD_WORDS", limit)
        got = sorted((list(r) for r in resampling.resample(given, aim, most, 997, (1, 3)).collect()), key=lambda r: repr(r[:5]))
        want = sorted(_want(docs, target, most, 997, (1, 3), 20), key=lambda r: repr(r[:5]))
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert {(r[0], r[5]) for r in got} == {(r[0], r[5]) for r in want}
    assert sorted(r[5] for r in got if r[5]) == list(range(1, 1 + max(r[5] or 0 for r in want)))


def test_head_is_exact_and_bounded(spark):
    docs = spark.createDataFrame([("a a a a b b c",), ("a b",), (None,)], "text string")
    words, pairs = resampling.head(docs, 2, limit=2, pair_limit=3)
    assert words == [b"a"] and pairs == [(b"a", b"a")]
    assert sorted(resampling.head(docs, 1, limit=9)[0]) == [b"a", b"b", b"c"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).isEmpty()
    some = spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string")
    got = resampling.resample(some, none, share=(1, 1)).collect()
    assert [(r["n_features"], r["rank"]) for r in got] == [(39, 1)]
    with pytest.raises(ValueError):
        resampling.resample(some, some, most=3)
