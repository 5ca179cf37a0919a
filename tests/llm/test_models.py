"""Models against brute force: likelihoods bit by bit, labels over all sequences, held-out accuracy."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tellurion.llm import langid, quality, scoring

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def _crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").cache()


# -- scoring ------------------------------------------------------------------------------------------------


def test_base_counts(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    words = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in rows}
    seen = Counter(w for i, _ in rows if _crc(i) % 7 != 2 for w in words[i])
    total = sum(seen.values())
    norm = math.log10(total + len(seen) + 1)
    got = {r["doc_id"]: r for r in scoring.op5_scoring(spark, DATA).collect()}
    assert set(got) == set(words)
    for i, w in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (_crc(i) % 7 == 2, len(w), sum(x in seen for x in w), total)
        assert r["base_score"] == pytest.approx(sum(math.log10(seen[x] + 1) for x in w) - len(w) * norm, rel=1e-9)
    # Held-out bytes are better foreseen than by their frequency.
    bytes_ = Counter(b for i, t in rows if _crc(i) % 7 != 2 for b in (t or "").translate(LOWER).encode())
    held = [(i, (t or "").translate(LOWER).encode()) for i, t in rows if _crc(i) % 7 == 2]
    alone = sum(math.log10((bytes_[b] + 1) / (sum(bytes_.values()) + 256)) for b in b"".join(t for _, t in held))
    assert sum(got[i]["score"] for i, _ in held) > 0.75 * alone


def _ctw(texts, alphabet, least):
    """log10 probability of a symbol after a context, by plain recursion over suffixes, one decision at a time."""
    seen = Counter()  # (context, nearest byte last; symbol)
    for t in texts:
        t = bytes([255]) * scoring.DEPTH + t + bytes([255])
        for i in range(scoring.DEPTH, len(t)):
            for d in range(scoring.DEPTH + 1):
                seen[t[i - d : i], int(alphabet.code[t[i]])] += 1
    total = Counter()
    for (c, _), n in seen.items():
        total[c] += n
    nodes = {c for c, n in total.items() if len(c) <= 2 or n >= least}
    children = {c: [x for x in nodes if len(x) == len(c) + 1 and x[1:] == c] for c in nodes}

    def bits(c, k):
        return tuple(sum(n * m[s, k] for s in range(alphabet.size) if (n := seen[c, s])) for m in (alphabet.zero, alphabet.one))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) if a + b else 0.0

    def weighted(c, k):
        own = kt(*bits(c, k))
        if len(c) == scoring.DEPTH:
            return own
        inner = [bits(x, k) for x in children[c]]
        below = sum(weighted(x, k) for x in children[c]) + kt(*(max(0, bits(c, k)[j] - sum(x[j] for x in inner)) for j in (0, 1)))
        return math.log((math.exp(own) + math.exp(below)) / 2)

    def one(context, k):
        p, left, above, d = 0.0, 1.0, 0.5, 0
        while True:
            c = context[len(context) - d :]
            a, b = bits(c, k)
            above = (b + 0.5) / (a + b + 1) if a + b else above
            if d == scoring.DEPTH or context[len(context) - d - 1 :] not in nodes:
                return p + left * above
            share = math.exp(kt(a, b) - math.log(2) - weighted(c, k)) if a + b else 1.0
            p, left, d = p + left * share * above, left * (1 - share), d + 1

    def symbol(context, s):
        return sum(math.log10(one(context, k) if alphabet.one[s, k] else 1 - one(context, k)) for k in range(alphabet.size - 1) if alphabet.one[s, k] or alphabet.zero[s, k])

    return symbol


@pytest.mark.parametrize("least", [1, 2])
def test_weighting_matches_recursion(spark, least):
    texts = [b"abracadabra", b"abacab", b"", b"cadabra"]
    alphabet, model, upper = scoring.learn(spark.createDataFrame([(bytearray(t),) for t in texts], "text binary"), least)
    got = model.collect()
    keys = np.concatenate([upper[0], *(np.frombuffer(r["keys"], np.uint64) for r in got)])
    rows = np.concatenate([upper[1], *(np.frombuffer(r["rows"], np.float16).reshape(-1, alphabet.size) for r in got)])
    assert np.allclose((10.0 ** rows.astype(float)).sum(1), 1, atol=5e-3)
    want = _ctw(texts, alphabet, least)
    lookup = scoring.Lookup(keys, rows)
    for t in (b"abracad", b"zzz", b"dab", b""):
        cells, _ = scoring.cells_of([t], alphabet.code)
        padded = bytes([255]) * scoring.DEPTH + t + bytes([255])
        brute = [want(padded[i : i + scoring.DEPTH], int(alphabet.code[padded[i + scoring.DEPTH]])) for i in range(len(t) + 1)]
        assert np.allclose(scoring.predicted(lookup, cells), brute, rtol=2e-3, atol=2e-3)


def test_many_parts_score_as_one(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the {w} sat on a {w} mat") for i, w in enumerate(["cat", "dog", "\u00e9t\u00e9", "cow", "owl", "ant", "bee", "elk", "fox", "hen"])], "doc_id long, text string")
    whole = {r["doc_id"]: r["score"] for r in scoring.score(docs).collect()}
    monkeypatch.setattr(scoring, "PART", 2000)
    assert {r["doc_id"]: pytest.approx(r["score"]) for r in scoring.score(docs).collect()} == whole


def test_scoring_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "a", "x"), (4, "b " * 200_000, "x")]
    got = {r["doc_id"]: r for r in scoring.score(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 1 and got[1]["score"] == pytest.approx(got[2]["score"])
    assert got[3]["n_tokens"] == 3 and got[4]["n_tokens"] == 200_001 and None in got
    assert scoring.score(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


# -- language ----------------------------------------------------------------------------------------------


def test_language_held_out(spark, documents):
    lang = {r["doc_id"]: r for r in documents.collect()}
    got = {r["doc_id"]: r for r in langid.op8_langid(spark, DATA).collect()}
    assert set(got) == set(lang)
    assert all(r["held_out"] == (_crc(i) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and lang[i]["lang"] is not None and re.search(r"[^\W\d_]", lang[i]["text"] or "")]
    assert sum(got[i]["lang_pred"] == lang[i]["lang"] for i in held) >= 0.95 * len(held)


def test_proportions_match_brute_force():
    rng = np.random.default_rng(5)
    ll, per = rng.normal(size=(30, 3)).astype(np.float32) * 3, np.array([12, 0, 18])
    main, share, _, _ = langid.infer(ll, per)
    at = 0
    for k, n in enumerate(per):
        if not n:
            assert main[k] == -1 and share[k] == 0
            continue
        x, fits = ll[at : at + n].astype(float), {}
        at += n

        def em(members, x=x):
            pi = np.array([m in members for m in range(3)], float) / len(members)
            for _ in range(langid.STEPS):
                part = pi * np.exp(x)
                pi = (part / part.sum(1, keepdims=True)).mean(0)
            return pi, np.log((np.exp(x) * pi).sum(1)).sum()

        full = em((0, 1, 2))[0]
        order = np.argsort(-full, kind="stable")
        for size in (1, 2, 3):
            pi, fitted = em(tuple(order[:size]))
            fits[size] = (fitted - langid.SET_PENALTY * (size - 1) * np.log(n + 1), pi)
        best = max(fits.values(), key=lambda f: f[0])[1]
        assert main[k] == best.argmax() and share[k] == pytest.approx(full[main[k]], abs=1e-5)


def test_language_edges(spark):
    rows = [(i, "the cat and the dog", "en", 1.0) for i in range(20)] + [(i, "le chat et le chien", "fr", None) for i in range(20, 40)]
    rows += [(50, None, "en", 1.0), (51, "", None, 1.0), (52, "12 34 !?", "fr", 1.0), (None, "le chien", "fr", 1.0), (53, "the dog " * 50_000, None, 1.0), (54, "Ω", None, 1.0)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.language_of(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")).collect()}
    assert got[50] == got[51] == got[52] == ("und", 0.0)
    assert got[53][0] == "en" and got[None][0] == "fr" and got[54][0] in ("en", "fr")
    nothing = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert langid.language_of(nothing).first()["lang_pred"] == "und"
    assert langid.language_of(nothing.limit(0)).isEmpty()


# -- quality -----------------------------------------------------------------------------------------------


def _base(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    again = [False] * len(words)
    for k, g in enumerate(zip(words, words[1:], words[2:])):
        if grams[g] > 1:
            again[k : k + 3] = [True] * 3
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, sum(again)


def test_base_rules(spark, documents):
    got = {r["doc_id"]: r for r in quality.op10_quality(spark, DATA).collect()}
    for r in documents.collect():
        g, (n, chars, symbols, lines, again) = got[r["doc_id"]], _base(r["text"])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (n, chars, symbols, lines, again)
        assert g["base_failed"] == (n < 50 or 100 * again > 50 * n)
        assert not (g["base_failed"] and g["kept"])


def test_verdict_follows_labels(spark, documents):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = [r for r in quality.op10_quality(spark, DATA).collect() if not r["base_failed"] and r["doc_id"] in labels]
    good, bad = ([r["kept"] for r in got if labels[r["doc_id"]] == q] for q in (1, 0))
    assert np.mean(good) > 0.95 and (not bad or np.mean(good) > np.mean(bad))


def test_viterbi_is_best():
    rng = np.random.default_rng(1)
    for n in range(7):
        e, t = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))

        def value(path, e=e, t=t):
            return sum(e[k, y] for k, y in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path))

        assert value(quality.viterbi(e, t)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=n))))


def test_fit_separates():
    rng = np.random.default_rng(2)
    chains = [(rng.normal(loc=y, scale=0.3, size=(9, quality.N_FEATURES)).astype(np.float32), y) for y in (0, 1) for _ in range(30)]
    w, t = quality.fit(chains)
    said = [np.mean(quality.viterbi(f @ w.T, t)) for f, _ in chains]
    assert all((s > 0.5) == bool(y) for s, (_, y) in zip(said, chains, strict=True))


def test_quality_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \n\n", 1), (4, "w " * 100_000, 1), (5, "\n".join(" ".join(f"{w}{i}" for w in ("plain", "line", "of", "several", "words")) + "." for i in range(20)), 1), (None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.rate(docs, none).collect()}
    assert all(got[i]["base_failed"] and not got[i]["kept"] and got[i]["n_words"] == 0 for i in (1, 2, 3))
    assert got[4]["base_failed"] and got[5]["kept"] and len(got[5]["labels"]) == 20 and got[None]["n_words"] == 1
    assert quality.rate(docs.limit(0), none).isEmpty()
