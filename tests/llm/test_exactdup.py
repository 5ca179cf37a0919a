"""Exact duplicates against a plain restatement, on odd inputs, in any batches; filters against the codes they hold."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tellurion.llm import _fuse, exactdup

TEXTS = [None, "", " \n", "a b", "ab", "a\tb", "A b", "a b", "é x", "éx", "long " * 3000, "long" * 3000, "\x00 z", "\x00z", "x" * 50]


def _rows():
    rng = np.random.default_rng(3)
    rows = [(int(i) * 7 % 101, TEXTS[int(k)], "no", 1, b"d") for i, k in enumerate(rng.integers(len(TEXTS), size=90))]
    return [*rows, (5, "solo", None, 2, None), (5, "solo", None, 2, None), (None, "ab", "x", 3, None), (None, "alone", "x", 3, None)]


def _want(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    out = []
    for bare, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0]))[0]
        out += [(d, keep, len(g), d == keep, hashlib.sha256(bare.encode()).hexdigest()) for d, _ in g]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), "doc_id int, text string, keep_id string, kept int, digest binary").cache()


def test_duplicates(docs, monkeypatch):
    assert sorted(map(tuple, exactdup.exact_duplicates(docs).collect()), key=repr) == _want(_rows())
    monkeypatch.setattr(exactdup, "SENT", 0)
    monkeypatch.setattr(exactdup, "SHARE", 8)
    monkeypatch.setattr(exactdup, "BUCKET", 4)
    one_by_one = [docs.where("doc_id is null or doc_id < 30"), docs.where("doc_id >= 30 and doc_id < 40"), docs.where("doc_id > 200"), docs.where("doc_id >= 40")]
    assert sorted(map(tuple, exactdup.exact_duplicates(docs, one_by_one).collect()), key=repr) == _want(_rows())


def test_empty_and_single_batch(docs):
    assert exactdup.exact_duplicates(docs.limit(0)).isEmpty()
    assert sorted(map(tuple, exactdup.exact_duplicates(docs, [docs]).collect()), key=repr) == _want(_rows())


def test_screen_holds_what_a_snapshot_holds(spark):
    old, new = (spark.range(a, b).selectExpr("id as doc_id", "concat('text ', id) as text") for a, b in ((0, 3000), (1000, 9000)))
    s = exactdup.snapshot(old, exactdup.screen(old, [])[1])
    known, fresh = exactdup.screen(new, [s])
    assert sorted(r["doc_id"] for r in known.collect()) == [*range(1000, 3000)] and fresh.count() == 6000
    groups = exactdup.grouped(exactdup.keyed(new))
    assert 2000 <= exactdup.screened(groups, 8000, s).count() <= 2060


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 40_000])
def test_filter(n):
    codes = np.random.default_rng(n).integers(0, 1 << 63, n + 20_000, dtype=np.uint64)
    kept, others = codes[:n], codes[n:]
    built = _fuse.build(np.concatenate([kept, kept]))
    assert _fuse.held(kept, *built).all() and _fuse.held(others, *built).mean() < 1 / 128
    assert len(built[2]) <= max(64, 1.6 * n)
