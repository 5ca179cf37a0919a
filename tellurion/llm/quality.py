"""Quality by labelling lines: a linear-chain conditional random field marks content or boilerplate.

The field is fitted on a bounded sample of labelled documents, each line taking its document's label, and
decoded by Viterbi over every document's lines. The share of words on content lines decides retention.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm._util import table

#: At most so many labelled documents of each class are fitted, those first by hash of doc_id.
SAMPLE = 1000
#: Lines of a training chain; longer documents give several chains.
CHAIN = 64
STEPS, RATE, RIDGE = 200, 0.1, 1e-3
CONTENT_SHARE = 0.5
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER, _DIGITS, _SPACE = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t\n\r\x0b\x0c"
N_FEATURES = 12


def line_features(line: bytes, seen_before: bool) -> list[float]:
    words, size = line.split(), len(line) + 1
    n = len(words)
    upper, lower = size - 1 - len(line.translate(None, _UPPER)), size - 1 - len(line.translate(None, _LOWER))
    return [
        1.0,
        min(1.0, 5 * (size - 1 - len(line.translate(None, SYMBOLS))) / size),
        min(1.0, 5 * line.count(b"!") / size),
        (size - 1 - len(line.translate(None, _DIGITS))) / size,
        upper / (upper + lower + 1),
        sum(map(eq, words, words[1:])) / max(1, n),
        1 - len(set(words)) / max(1, n),
        float(line[-1:] in (b".", b"!", b"?")),
        min(1.0, n / 50),
        float(n < 4),
        float(seen_before),
        min(1.0, len(line) / max(1, n) / 20),
    ]


def document_features(text: bytes) -> tuple[np.ndarray, list[int], int]:
    """Features of the lines that hold a word, their words, and how many of them equal an earlier line."""
    rows, words, seen, repeated = [], [], set(), 0
    for line in text.split(b"\n"):
        if n := len(line.split()):
            again = line in seen
            repeated += again
            seen.add(line)
            rows.append(line_features(line, again))
            words.append(n)
    return np.array(rows, np.float32).reshape(-1, N_FEATURES), words, repeated


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


def fit(chains: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (2 x features) and transitions (2 x 2) that maximise the conditional likelihood.

    ``chains``: features of consecutive lines and their label (1 content, 0 boilerplate). Both classes weigh
    alike. Gradients come from forward-backward over all chains at once.
    """
    n = len(chains)
    x, mask, y = np.zeros((n, CHAIN, N_FEATURES)), np.zeros((n, CHAIN)), np.array([c[1] for c in chains])
    for i, (f, _) in enumerate(chains):
        x[i, : len(f)], mask[i, : len(f)] = f, 1
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    length = mask.sum(1).astype(int)
    gold = np.zeros((n, CHAIN, 2))
    gold[np.arange(n), :, y] = 1
    w, t = np.zeros((2, N_FEATURES)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    per_line = (weight / length)[:, None] * mask
    for step in range(1, STEPS + 1):
        e = x @ w.T
        a, b = np.zeros((n, CHAIN, 2)), np.zeros((n, CHAIN, 2))
        a[:, 0] = e[:, 0]
        for k in range(1, CHAIN):
            a[:, k] = np.where(mask[:, k, None] > 0, e[:, k] + _log_sum(a[:, k - 1, :, None] + t, 1), a[:, k - 1])
        for k in range(CHAIN - 2, -1, -1):
            b[:, k] = np.where(mask[:, k + 1, None] > 0, _log_sum(t + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2), 0)
        z = _log_sum(a[:, -1], 1)
        post = np.exp(a + b - z[:, None, None])
        pair = np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
        both = per_line[:, 1:]
        gw = np.einsum("nk,nkc,nkf->cf", per_line, gold - post, x) - RIDGE * w
        want = np.zeros((2, 2))
        for c in (0, 1):
            want[c, c] = both[y == c].sum()
        gt = want - np.einsum("nk,nkij->ij", both, pair) - 10 * RIDGE * t
        for value, grad, m, v in ((w, gw, *moments[:2]), (t, gt, *moments[2:])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, t


def viterbi(e: np.ndarray, t: np.ndarray) -> list[int]:
    """The best labels of a chain with emissions ``e`` (lines x 2); ties go to content."""
    (t00, t01), (t10, t11) = t.tolist()
    rows = e.tolist()
    if not rows:
        return []
    a, b = rows[0]
    back = []
    for x, y in rows[1:]:
        from0, from1 = a + t00 > b + t10, a + t01 > b + t11
        back.append((0 if from0 else 1, 0 if from1 else 1))
        a, b = (a + t00 if from0 else b + t10) + x, (a + t01 if from1 else b + t11) + y
    label = 0 if a > b else 1
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(index) + ids[1:]
    if len(index) > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    start = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= start
    return int(covered.sum())


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The field fitted on at most ``SAMPLE`` labelled documents of each class; None if a class is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(f[k : k + CHAIN].tobytes(), y) for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True) for f in [document_features(t.as_py())[0]] for k in range(0, len(f), CHAIN)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32())], names=["features", "label"])

    one = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), "quality")
    picked = [one.where(F.col("quality") == q).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for q in (0, 1)]
    sample = docs.join(F.broadcast(picked[0].union(picked[1])), F.col("doc_id") == F.col("id"))  # at most 2 * SAMPLE rows
    rows = sample.where("text is not null").select(F.col("text").cast("binary"), F.col("quality").cast("int")).mapInArrow(run, "features binary, label int").toArrow()
    chains = [(np.frombuffer(f, np.float32).reshape(-1, N_FEATURES), y) for f, y in zip(rows["features"].to_pylist(), rows["label"].to_pylist(), strict=True)]
    chains.sort(key=lambda c: (c[1], c[0].tobytes()))  # sums in one order: reruns agree
    return fit(chains) if len({y for _, y in chains}) == 2 else None


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long, labels string"


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts and the line labels of ``docs(doc_id, text)``, one row a document.

    ``labels`` (string) has a digit per line with a word, 1 content; ``content_words`` counts words on such
    lines; ``base_failed`` and ``kept`` decide. Null or empty text: no lines, all counts 0, base_failed.
    Without labelled documents of both classes every line is content and the base rules decide alone.
    Repeated rows are rated each; an empty table gives no rows; other columns are not read. ``labels(doc_id,
    quality)`` with other values or nulls are ignored.
    """
    model = fitted(docs.select("doc_id", "text"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = value.as_py() or b""
                words = text.split()
                features, per, repeated = document_features(text)
                said = [1] * len(per) if model is None else viterbi(features @ model[0].T, model[1])
                chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, _SPACE)))
                out.append((doc_id, len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), repeated, repeat_words(words), sum(n for n, y in zip(per, said, strict=True) if y), "".join(map(str, said))))
            columns = zip(*out, strict=True) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, [pa.int64()] * 7 + [pa.string()], strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    rated = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, SCHEMA)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return rated.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_words") >= CONTENT_SHARE * F.col("n_words")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")
