"""Corpus operators against brute force on small tables with nulls, empty texts, ties and repeats."""

import re
from collections import defaultdict

import numpy as np
import pytest

from tellurion.llm import ann, chat, linedup, mixing, neardup, packing, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def _texts():
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocab, 60)) for _ in range(12)]
    near = []
    for t in base[:4]:
        for _ in range(4):
            w = t.split()
            w[int(rng.integers(60))] = "edit"
            near.append(" ".join(w))
    long = " ".join(rng.choice(vocab, 5000))
    return [None, "", "  \n\t", "one two", "One Two", "three", *base, *near, base[0], base[0], long, long + " tail", "x " + base[1] + " y\n" + base[2]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(_texts())], "doc_id long, text string, component_id string").cache()


def test_near_duplicates(docs):
    sets = []
    for t in _texts():
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(sets)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for b in range(len(sets)):
        for a in range(b):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in enumerate(sets)}


def test_near_duplicates_of_short_texts_held_in_longer_ones(spark):
    """Pairs of 64 to 160 shingles, one set within the other, at a similarity of 0.75 to 0.8."""
    rng, rows, want = np.random.default_rng(8), [], {}
    for i in range(600):
        size = int(rng.integers(86, 161))
        part = int(rng.integers(-(-75 * size // 100), 80 * size // 100 + 1))
        words = [f"p{i}w{k}" for k in range(size + 4)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: part + 4]))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i}
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_substring(docs):
    seen, want = set(), {}
    for i, t in enumerate(_texts()):
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 13]) for k in range(len(w) - 12)]
        drop = [False] * len(w)
        for k, g in enumerate(grams):
            if g in seen:
                drop[k : k + 13] = [True] * 13
        seen.update(grams)
        want[i] = (len(w), sum(drop), " ".join(x for x, d in zip(w, drop, strict=True) if not d))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(docs).collect()} == want


def test_patience_blocks():
    a, b = np.array([1, 2, 3, 4, 5, 5]), np.array([9, 2, 3, 8, 4, 5, 5])
    assert linedup.patience_blocks(a, b) == [(1, 3), (4, 7)]
    assert linedup.patience_blocks(np.array([1, 2, 3]), np.array([3, 2, 1])) in ([(0, 1)], [(1, 2)], [(2, 3)])


def test_line_dedup(spark):
    lines = [f"line {i} has several plain words in it" for i in range(8)]
    rows = [(1, "\n".join(lines[:5])), (2, "\n".join(["a fresh start with its own words here", *lines[1:4], "end"])), (3, None), (4, ""), (5, "end")]
    got = {r["doc_id"]: r for r in linedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0
    assert got[2]["text"] == "a fresh start with its own words here\nend" and got[2]["n_removed"] == 3
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "end"


def test_patience_blocks_without_unique_lines():
    twice = np.array([1, 2, 3, 1, 2, 3])
    assert linedup.patience_blocks(twice, twice) == [(0, 6)]  # no anchor: heads
    assert linedup.patience_blocks(np.array([7, *twice, 8]), np.array([9, *twice, 6])) == [(1, 7)]  # no anchor, no head: the longest block
    assert linedup.patience_blocks(np.array([1, 4, 5, 2, 4, 5, 3]), np.array([1, 9, 4, 5, 8, 2, 3])) == [(0, 1), (2, 4), (5, 7)]  # twice held, once in its gap
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = rng.integers(0, 6, rng.integers(0, 15)), rng.integers(0, 6, rng.integers(0, 15))
        blocks = linedup.patience_blocks(a, b)
        assert all(s < e for s, e in blocks) and all(x[1] < y[0] for x, y in zip(blocks, blocks[1:], strict=False))
        lines = iter(a.tolist())
        assert all(x in lines for s, e in blocks for x in b[s:e].tolist())  # a common subsequence
        assert linedup.patience_blocks(a, a) == ([(0, len(a))] if len(a) else [])


def test_line_dedup_of_short_lines(spark):
    verse = [f"short line {i}" for i in range(8)]
    rows = [(1, "\n".join(["own start", *verse, "own end"])), (2, "\n".join(["other start", *verse[:5], "other end"])), (3, "\n".join(verse[:3]))]
    double = "\n".join([f"a line with rather more words {i}" for i in range(4)] * 2)
    rows += [(4, double), (5, double), (6, "\n".join(["before", *double.split("\n"), "after"]))]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("other start\nother end", 5), 3: (rows[2][1], 0), 4: (double, 0), 5: ("", 8), 6: ("before\nafter", 8)}


def test_nearest(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8)).astype(np.float32)
    v[50] = v[20]
    v[60:70] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(200, None), (201, [0.0] * 8), (202, [None] * 8), (220, [float("nan")] * 8)]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), ann.F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert sorted(got) == list(range(0, 200, 20))
    m = v.astype(float)
    for q, found in got.items():
        score = np.zeros(200)
        for j in range(8):
            score += m[q, j] * m[:, j]
        assert found == [i for i in np.lexsort((np.arange(200), -score)).tolist() if i != q][:20]


def test_nearest_is_whole_on_a_larger_table(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(12_000, 32))
    v[9000:] += 3 * rng.normal(size=(10, 32))[rng.integers(10, size=3000)]  # a part lies in clusters, the rest everywhere
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[150:200] = v[100]
    got = defaultdict(list)
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    for r in ann.search(table, ann.F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert sorted(got) == list(range(0, 12_000, 100))
    for q, found in got.items():
        score = np.zeros(len(v))
        for j in range(32):
            score += v[q, j] * v[:, j]
        assert found == [i for i in np.lexsort((np.arange(len(v)), -score)).tolist() if i != q][:20]


def test_packing_is_whole(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, by_doc, by_window = Tokenizer.from_file(path), defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, path).collect():
        by_doc[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        by_window[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(_texts()):
        assert sum((x for _, x in sorted(by_doc[i])), []) == [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (i % 17), ["a", "b", None][i % 3]) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    assert all(abs(taken[s] - target[s]) <= 17 for s in target)


def test_perspectives(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (2, 0, "system", "alone")]
    got = {r["speaker"]: (r["mask"], r["trained_chars"]) for r in chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {"ann": ("010", 2), "bob": ("001", 0)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(none).isEmpty() and substring.remove_repeats(none).isEmpty() and linedup.drop_repeated_lines(none).isEmpty()
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), ann.F.col("vec_id") % 20 == 0).isEmpty()


def test_pipeline_small(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").isEmpty() and not out.isEmpty()
    assert set(out.columns) >= {"doc_id", "start", "length", "ids"}
