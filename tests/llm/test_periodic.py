"""Periodic runs against lag by lag comparison of words, on texts made to repeat, and the query against a plain restatement."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tellurion.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain(words):
    """All runs, by start and period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        s = 0
        while s < n - q:
            e = s
            while e < n - q and words[e] == words[e + q]:
                e += 1
            if e > s and e + q - s >= max(8, 2 * q):
                found.setdefault((s, e + q), q)
            s = e + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= 12)


def _repetitive(rng, n):
    """Random words, repeats of a part of what is there, powers, and powers of powers."""
    letters = [f"w{k}" for k in range(int(rng.choice([2, 3, 40])))]
    out = list(rng.choice(letters, int(rng.integers(1, 30))))
    while len(out) < n:
        kind, a = rng.integers(5), int(rng.integers(len(out)))
        if kind == 0:
            out += list(rng.choice(letters, int(rng.integers(1, 60))))
        elif kind == 1:
            out += out[a:] * int(rng.integers(1, 5))
        elif kind == 2:
            unit = out[a : a + int(rng.integers(1, 6))]
            out += unit * int(rng.integers(5, 60)) + unit[: int(rng.integers(len(unit) + 1))]
        elif kind == 3:
            unit = list(rng.choice(letters, int(rng.integers(1, 4))))
            part = unit * int(rng.integers(2, 30)) + [str(rng.choice(letters))]
            out += part * int(rng.integers(1, 4)) + part[: int(rng.integers(len(part)))]
        else:
            out += out[a : a + int(rng.integers(1, 200))]
    return [str(x) for x in out[:n]]


@pytest.mark.parametrize("seed", range(12))
def test_runs(seed):
    rng = np.random.default_rng(seed)
    texts = [_repetitive(rng, int(n)) for n in rng.choice([0, 1, 5, 13, 80, 200, 500, 900], 12)]
    for words, got in zip(texts, periodic.runs_of([[x.encode() for x in t] for t in texts]), strict=True):
        assert list(map(tuple, got.tolist())) == _plain(words)


@pytest.mark.parametrize("words", [
    ["a"] * 1500,
    (["a", "b"] * 40 + ["a"]) * 2 + ["x"] + (["a", "b"] * 90 + ["a"]) * 3,
    (["a"] * 100 + ["x"]) * 12,
    (["a", "b", "c"] * 70 + ["a"] + ["a", "b", "c"] * 80),
    (["a"] * 70 + ["b"] + ["a"] * 90 + ["c"]) * 5,
])
def test_runs_of_runs(words):
    assert list(map(tuple, periodic.runs_of([[x.encode() for x in words]])[0].tolist())) == _plain(words)


def test_long_period():
    rng = np.random.default_rng(0)
    unit = [b"%d" % x for x in rng.integers(0, 5000, 30_011)]
    got = periodic.runs_of([[b"z"], unit * 3 + unit[:7], unit])
    assert got[1].tolist() == [[0, 90_040, 30_011]] and not len(got[0]) and not len(got[2])


def test_collisions_are_settled_by_words(monkeypatch):
    monkeypatch.setattr(periodic._Prefixes, "same", lambda self, a, b, length: np.ones(len(a), bool))
    words = [b"%d" % x for x in np.random.default_rng(1).integers(0, 3000, 50)] * 3 + [b"%d" % x for x in range(200)] + [b"q"] * 30
    assert list(map(tuple, periodic.runs_of([words])[0].tolist())) == _plain(words)


def _query(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = _plain(words)
    drop = {k for s, length, q in runs for k in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in drop)))


def test_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, "  ".join(_repetitive(rng, int(rng.integers(0, 120)))) + "\n x", "t") for i in range(60)]
    rows += [(60, None, None), (61, "", "t"), (62, " \n\t", "t"), (63, "naïve\x00 　é " * 9, "t"), (None, "a " * 13, "t"), (5, "a b " * 7, "t"), (5, "a b " * 7, "t")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op11_periodic(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((_query(d, t) for d, t, _ in rows), key=repr)
    assert periodic.periodic_runs(spark.createDataFrame(rows[:0], "doc_id long, text string, runs string")).isEmpty()
