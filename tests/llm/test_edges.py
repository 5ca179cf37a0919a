"""Plain restatements of mixing, line removal, packing and the pipeline, and inputs that are odd: nulls, repeats, clashing names."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tellurion.llm import _util, ann, chat, langid, linedup, mixing, neardup, packing, quality, scoring, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


# -- mixing ------------------------------------------------------------------------------------------------


def _targets(sizes, weights=(1, 2, 3), most=3.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped = {}
    while True:
        free = [s for s in sizes if s not in capped]
        rest, total = sum(sizes.values()) - sum(capped.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return capped | {s: rest * weight[s] / total for s in free}
        capped |= {s: most * sizes[s] for s in over}


def test_mixing_matches_plain_solver(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 40)), s) for i, s in enumerate(rng.choice(["a", "b", "c", "B", None], 400, p=[0.6, 0.2, 0.1, 0.05, 0.05]).tolist())]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = _targets(dict(sizes))
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s, goal in want.items():
        mine = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(goal) and r["source_size"] == sizes[s] for r in mine)
        scale = sum(r["size"] ** 2 for r in mine) / sizes[s]
        low, high = -60.0, 60.0
        for _ in range(200):  # plain bisection for the multiplier
            lam = (low + high) / 2
            total = sum(r["size"] * min(3.0, math.exp(min(50, lam * r["size"] / scale))) for r in mine)
            low, high = (lam, high) if total < goal else (low, lam)
        for r in mine:
            assert r["rate"] == pytest.approx(min(3.0, math.exp(lam * r["size"] / scale)) if r["size"] else 1.0, rel=1e-4)
            assert abs(r["copies"] - r["rate"]) < 2 and 0 <= r["copies"] <= 3
        assert abs(sum(r["copies"] * r["size"] for r in mine) - goal) <= 40


def test_mixing_odd_inputs(spark):
    names = ["scale", "limit", "by", "at", "of", "bin", "for", "turned", "row", "lam", "left", "n"]
    rows = [(i % 9, None if i == 3 else "w " * (i % 7) if i else "w " * 100_000, "s", *[k for k in range(len(names))]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names))
    out = mixing.mix(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == 40
    assert all([r[c] for c in names] == list(range(len(names))) for r in out.collect())
    assert mixing.mix(docs.limit(0)).isEmpty()
    assert [r["copies"] for r in mixing.mix(docs.where("text is null")).collect()] == [1]


# -- lines -------------------------------------------------------------------------------------------------


def _plain_line_dedup(texts):
    """Texts whose lines are distinct and keep their order: the alignment is their longest common run of lines."""
    tables = {i: [x.split() for x in (t or "").split("\n")] for i, t in texts.items()}
    held = defaultdict(list)
    for i, lines in tables.items():
        for k, words in enumerate(lines):
            if len(words) >= 6:
                held[tuple(words)].append(i)
            if words:
                total = 0
                for e in range(k, len(lines)):
                    total += len(lines[e])
                    if total >= 12:
                        held[tuple(map(tuple, lines[k : e + 1]))].append(i)
                        break
    out = {}
    for i, lines in tables.items():
        gone = set()
        for first in {min(v) for v in held.values() if i in v and min(v) < i}:
            a, b = [" ".join(x) for x in tables[first]], [" ".join(x) for x in lines]
            common = [x in a for x in b]
            k = 0
            while k < len(b):
                e = k
                while e < len(b) and common[e] and (e == k or a.index(b[e]) > a.index(b[e - 1])):
                    e += 1
                if sum(len(lines[x]) for x in range(k, e)) >= 12:
                    gone |= {x for x in range(k, e) if lines[x]}
                k = max(e, k + 1)
        raw = (texts[i] or "").split("\n")
        out[i] = "\n".join(x for k, x in enumerate(raw) if k not in gone) if gone else texts[i]
    return out


def test_line_dedup_matches_plain(spark):
    rng = np.random.default_rng(11)
    pool = [" ".join([f"l{i}", *rng.choice(["red", "blue", "green", "gold"], int(rng.integers(1, 11)))]) for i in range(60)]
    texts = {}
    for i in range(40):
        at, n = int(rng.integers(0, 50)), int(rng.integers(2, 10))
        lines = [x for x in pool[at : at + n] if rng.random() > 0.15]
        for _ in range(2):
            lines.insert(int(rng.integers(0, len(lines) + 1)), f"own{i} " + " ".join(map(str, rng.integers(0, 999, 4))) + f" {len(lines)}")
        texts[i] = "\n".join(lines)
    got = {r["doc_id"]: r["text"] for r in linedup.drop_repeated_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == _plain_line_dedup(texts)
    assert any(got[i] != t for i, t in texts.items())


def test_line_dedup_odd_inputs(spark):
    block = "\n".join(f"some words of line number {k}" for k in range(3))
    rows = [(None, block), (1, block), (1, block), (2, f"{block}\nown"), (3, "\n".join(f"long {k}" for k in range(60_000)))]
    docs = spark.createDataFrame([(i, t, 7, 8, 9, 10) for i, t in rows], "doc_id long, text string, gone int, `of` int, n_lines int, said int")
    out = linedup.drop_repeated_lines(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["gone"], r["of"], r["said"]) for r in out) == [(0, 0, 7, 8, 10), (1, 0, 7, 8, 10), (1, 0, 7, 8, 10), (2, 3, 7, 8, 10), (3, 0, 7, 8, 10)]


# -- packing -----------------------------------------------------------------------------------------------


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(60):
        pos = np.cumsum(np.concatenate([[0], rng.integers(60, 420, 9)]))
        penalty, width = np.concatenate([[0], rng.integers(0, 60, 9)]).astype(float), 1024

        def cost(cuts, pos=pos, penalty=penalty, width=width):
            total = 0.0
            for i, j in itertools.pairwise(cuts):
                n = pos[j] - pos[i]
                if n > width:
                    return math.inf
                total += penalty[j] + (packing.BUCKET_COST if n in (256, 512) and packing.BUCKET_COST < width - n else width - n)
            return total

        best = min(cost((0, *some, 9)) for k in range(9) for some in itertools.combinations(range(1, 9), k))
        assert cost(packing.plan_cuts(pos, penalty, width)) == pytest.approx(best)


def test_blocks_carry_over(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), np.random.default_rng(3)
    texts = [" ".join(rng.choice(["the", "stone.", "House", "it's", "Été", "42", "日本", "áb"], int(rng.integers(0, 700)))) for _ in range(60)]
    packer, rows, tok = packing._Packer(path, 512, 3), [], Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        packer.add(i, t.encode())
        if packer.size >= 2000:
            rows += packer.flush(last=False)
    rows += packer.flush(last=True)
    ids, fill = defaultdict(list), Counter()
    for doc, start, length, tokens, window, offset, raw in rows:
        assert start == len(ids[doc]) and offset == fill[window] and len(raw) == 4 * length
        ids[doc] += np.frombuffer(raw, "<u4").tolist()
        fill[window] += length
        assert tokens == len(tok.encode(texts[doc], add_special_tokens=False).ids) + 1
    assert all(ids[i] == [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts))
    assert max(fill.values()) <= 512 and sum(fill.values()) / sum(n if n & (n - 1) == 0 else 512 for n in fill.values()) > 0.94


def test_packing_query(spark, tmp_path):
    rows = [(1, None), (None, "no id"), (3, ""), (4, "w " * 5000), (5, "again"), (5, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    got = packing.op1_packing(spark, str(tmp_path)).collect()
    for r in got:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and r["doc_tokens"] == len(want[r["doc_id"]])
    assert sum(r["length"] for r in got) == sum(len(want[i]) for i, _ in rows)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).isEmpty()


# -- others ------------------------------------------------------------------------------------------------


def test_null_ids_are_left_out(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A B c d e f g")], "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.near_duplicates(docs).collect()) == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False)]
    assert sorted(r["doc_id"] for r in substring.remove_repeats(docs).collect()) == [1, 1, 2]


def test_near_duplicates_of_a_large_group(spark):
    """Near copies in chains and stars, and many documents that share a passage without being alike."""
    rng, texts = np.random.default_rng(4), []
    base = [f"b{k}" for k in range(80)]
    for i in range(120):
        w = list(base)
        for at in rng.integers(0, 80, int(rng.integers(0, 4))):
            w[at] = f"x{i}"
        texts.append(w)
    chain = [f"c{k}" for k in range(300)]
    texts += [chain[k : k + 100] for k in range(0, 200, 9)]
    passage = [f"p{k}" for k in range(40)]
    texts += [[*passage, *(f"o{i}w{k}" for k in range(14))] for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets, parent = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {i: root(i) for i in range(len(texts))}


def test_substring_with_a_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD", 40)
    monkeypatch.setattr(substring, "STREAM", 100)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [f"own{i} start{i} {passage} tail{i} of its own" if i % 3 else f"{passage} {' '.join(f'q{i}{k}' for k in range(20))}" for i in range(90)]
    got = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: 30 if i else 0 for i in range(90)}


def test_perspectives_odd_inputs(spark):
    rows = [(1, k, "system" if k == 0 else f"s{k % 3}", f"t{k}", 5) for k in range(-2, 600)] + [(None, None, None, None, 5), (None, None, None, None, 5), (2, 1, "b", "y", 5), (2, 1, "a", "x", 5)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, speaker int")
    got = {(r["conv_id"], r["speaker"]): r for r in chat.perspectives(table).collect()}
    assert set(got) == {(1, "s0"), (1, "s1"), (1, "s2"), (None, "unknown"), (2, "a"), (2, "b")}
    long = got[1, "s1"]
    assert [m["turn"] for m in long["messages"]] == list(range(-2, 600)) and len(long["mask"]) == 602 and long["messages"][2]["role"] == "system"
    assert [long["rendered"][s["start"] : s["start"] + s["length"]] for s in long["trained_spans"]] == [f"t{k}" for k in range(-2, 600) if k and k % 3 == 1]
    assert got[None, "unknown"]["mask"] == "11" and got[2, "a"]["rendered"] == "<|assistant|>\nx\n<|user name=b|>\ny\n"
    assert chat.perspectives(table.limit(0)).isEmpty()


def test_nearest_odd_inputs(spark):
    rows = [(i, [float(i % 5)]) for i in range(30)] + [(7, [2.0]), (8, [3.0]), (None, [1.0]), (99, [1.0, 2.0])]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, rank int, cell string"), ann.F.col("vec_id") % 10 == 1).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    v = {i: float(i % 5) for i in range(30)} | {7: 2.0, 8: 3.0}
    v = {i: x for i, x in v.items() if x}
    assert got == {q: sorted((i for i in v if i != q), key=lambda i: (-v[i] * v[q], i))[:20] for q in (1, 11, 21)}


def test_languages_beyond_three_and_odd_inputs(spark):
    words = {f"l{k}": [f"{chr(97 + k)}{chr(98 + k)}{chr(97 + k)}{j}" * 2 for j in "uvw"] for k in range(6)}
    rows = [(i, " ".join(words[f"l{i % 6}"] * 20), f"l{i % 6}", "c") for i in range(60)]
    rows += [(100, None, "l1", "c"), (101, "123 !", "l1", "c"), (102, " ".join(w for k in range(5) for w in words[f"l{k}"] * 30), None, "c"), (None, "abau", "l0", "c")]
    out = {r["doc_id"]: r for r in langid.language_of(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")).collect()}
    assert out[100]["lang_pred"] == out[101]["lang_pred"] == "und" and out[100]["langs"] == []
    assert out[102]["langs"] == [f"l{k}" for k in range(5)]
    assert all(out[i]["lang_pred"] == f"l{i % 6}" for i in range(60))
    assert langid.language_of(spark.createDataFrame([], "doc_id long, text string, lang string")).isEmpty()


def test_quality_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "a b", 0), (3, "w " * 50_000, 0), (3, "w " * 50_000, 0)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["base_failed"]) for r in quality.rate(docs, labels).collect()))
    assert got == [(0, 2, True), (1, 0, True), (3, 50_000, True), (3, 50_000, True)]


def test_quality_gradient_follows_the_likelihood():
    """The fitted field is at a maximum of the penalised likelihood, computed by sums over all label sequences."""
    rng = np.random.default_rng(9)
    chains = [(np.concatenate([np.ones((n, 1)), rng.normal(size=(n, quality.N_FEATURES - 1)) + y], 1).astype(np.float32), y) for y in (0, 1) for n in rng.integers(1, 4, 6)]
    w, t = quality.fit(chains)
    weight = {y: 0.5 / sum(c[1] == y for c in chains) for y in (0, 1)}

    def likelihood(w, t):
        total = 0.0
        for x, y in chains:
            e = x @ w.T
            score = lambda s: sum(e[k, c] for k, c in enumerate(s)) + sum(t[a, b] for a, b in itertools.pairwise(s))  # noqa: B023, E731
            total += weight[y] / len(x) * (score([y] * len(x)) - math.log(sum(math.exp(score(s)) for s in itertools.product((0, 1), repeat=len(x)))))
        return total

    at = likelihood(w, t)
    plain = likelihood(np.zeros_like(w), np.zeros_like(t))
    assert at > plain / 3 and at > likelihood(w * 0.8, t)


def test_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default=None: None)

    class Spark:
        conf = Conf

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        _util.shared_folder(Spark)


# -- pipeline ----------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, outs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs if not outs else outs[-1], "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{name}")
        outs.append(spark.read.parquet(f"{tmp_path}/{name}"))
    first, lines, near, mixed, packed = ([r.asDict() for r in x.collect()] for x in outs)
    fit = {r["doc_id"]: r["fit"] for r in langid.language_of(docs).collect()}
    assert {r["doc_id"] for r in first} == {r["doc_id"] for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or "") and fit[r["doc_id"]] >= 0}
    assert min(r["fit"] for r in langid.language_of(outs[0]).collect()) > 1
    removed = {r["doc_id"]: r for r in linedup.drop_repeated_lines(outs[0]).collect()}
    assert {r["doc_id"]: r["text"] for r in lines} == {i: r["text"] for i, r in removed.items() if WORD.search(r["text"]) or r["n_removed"] == 0}
    sets = {}
    for r in lines:
        w = WORD.findall(r["text"].translate(LOWER))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r["doc_id"] for r in near} == {i for i in sets if root(i) == i}
    copies = Counter(r["doc_id"] for r in mixed)
    assert {i: n for r in mixing.mix(outs[2]).collect() if (n := r["copies"]) and (i := r["doc_id"]) is not None} == copies
    tok, said, tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {r["doc_id"]: r["text"] for r in near}, Counter()
    for r in packed:
        ids = [*tok.encode(said[r["doc_id"]], add_special_tokens=False).ids, 1]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["start"] : r["start"] + r["length"]]
        tokens[r["doc_id"]] += r["length"]
    assert all(tokens[i] == n * (len(tok.encode(said[i], add_special_tokens=False).ids) + 1) for i, n in copies.items())
    assert scoring and corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == outs[-1].columns


def test_language_stage_rejects_what_no_language_explains(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyz   ")
    odd = ["".join(rng.choice(letters, 600)) for _ in range(5)] + ["Привет, как дела сегодня", "日本語のテキスト です", "zzzz qqqq xxxx jjjj"]
    more = spark.createDataFrame([(10_000_000 + k, t, None, "odd", len(t)) for k, t in enumerate(odd)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(more), "").select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.where(docs["text"].rlike(r"\p{L}")).select("doc_id").collect()}


def test_pipeline_column_names(spark, tmp_path):
    """Names with dots, blanks and back quotes, and the stages' own in another case."""
    import corpus_pipeline

    names = ["a.b", "Score", "N_lines", "Size", "row.c0", "x y", "b`q", "LANGS", "Kept"]
    rows = [(1, "Some words of a text here.", "en", "a"), (2, "other words in it", "en", "b"), (3, "Some words of a text here.", "en", None)]
    docs = got = spark.createDataFrame([(*r, 9, *range(len(names))) for r in rows], ["doc_id", "text", "lang", "source", "N_chars", *names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, got, "").write.parquet(f"{tmp_path}/{name}")
        got = spark.read.parquet(f"{tmp_path}/{name}")
        assert got.columns == docs.columns and not got.isEmpty() and all(list(r)[5:] == list(range(len(names))) for r in got.collect()), name


def test_pipeline_odd_inputs(spark, tmp_path):
    import corpus_pipeline

    names = ["score", "langs", "held_out", "n_lines", "copies", "size", "gone", "of", "row", "component_id", "kept", "key"]
    rows = [(1, "Some words of a text here.", "en", "a"), (1, "Some words of a text here.", "en", "a"), (None, "other words in it", "en", None), (2, None, "en", "a"), (3, "", None, "a"), (4, "123", "en", "b"), (5, "w" * 300_000, "en", "b")]
    docs = spark.createDataFrame([(*r, 9, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in names))
    got = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, got, "").write.parquet(f"{tmp_path}/{name}")
        got = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert got.columns == docs.columns and all([r[c] for c in names] == list(range(len(names))) for r in got.collect())
    assert {r["doc_id"] for r in got.collect()} <= {1, None, 5} and not got.isEmpty()
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
    assert none.isEmpty()
