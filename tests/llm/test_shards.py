"""Shards of passages stay bounded where one document holds them all first."""

import numpy as np

from tellurion.llm import substring


def test_a_long_first_holder_is_spread(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD", 2000)
    monkeypatch.setattr(substring, "PART", 256)
    words = [f"w{x}" for x in np.random.default_rng(1).integers(0, 50_000, 20_000)]
    rows = [(1, " ".join(words))] + [(2 + k, " ".join([*words[2000 * k : 2000 * k + 2500], f"end{k}"])) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranges = substring.repeated_ranges(docs)
    parts = substring._passages(docs, ranges, 10).where("given").collect()
    held = np.zeros(10, int)
    for r in parts:
        held[r["shard"]] += len(bytes(r["words"]).split())
    assert held.sum() >= 18_500 and held.max() < 3 * 2000 and (held > 0).all()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.remove_repeats(docs).collect()}
    assert got == {1: (20_000, 0)} | {2 + k: (2501, 2500) for k in range(9)}
