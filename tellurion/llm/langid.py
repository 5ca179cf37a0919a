"""Language identification as inference of a multilingual mixture.

Byte-trigram likelihoods a language are counted from labelled documents. A document is a mixture: each word
comes from one language, the proportions are estimated by expectation-maximisation, and the set of languages
is the one among nested sets (by estimated proportion) whose penalised likelihood is best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from tellurion.llm._util import apart, lean, table

UNKNOWN = "und"
#: Trigrams are hashed into so many buckets; the model holds a row of 256 KB a language.
BUCKETS = 1 << 16
#: Above so many languages the model is too large to send to every task, and ``learn`` raises. (ISO 639-1 has 183.)
MOST_LANGUAGES = 1024
SMOOTHING, STEPS, SET_PENALTY = 0.5, 8, 2.0
#: Bytes of text that are scored at once.
CHUNK = 1 << 20
_LETTERS = bytes(c if chr(c).islower() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))


def folded(text: str) -> bytes:
    return b"  " + text.lower().encode("utf-8", "replace").translate(_LETTERS)


def grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that ends at each position from 2 on, and whether it touches a letter in its last two."""
    code = (buf[:-2].astype(np.uint32) << 16) | (buf[1:-1].astype(np.uint32) << 8) | buf[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16), (buf[1:-1] != 32) | (buf[2:] != 32)


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log probabilities by bucket, from ``labelled(lang, text)``.

    What reaches the driver is one count a language and bucket. All languages are learned; more than
    ``MOST_LANGUAGES`` are an error. Rows with a null in either column teach nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                bucket, real = grams(np.frombuffer(folded(text.as_py()) + b" ", np.uint8))
                count = np.bincount(bucket[real], minlength=BUCKETS) if len(bucket) > 4096 else None
                into = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                if count is None:
                    np.add.at(into, bucket[real], 1)
                else:
                    into += count
        for lang, count in seen.items():
            at = np.nonzero(count)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(count[at])], names=["lang", "bucket", "n"])

    known = labelled.select("lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.mapInArrow(lean(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if len(known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    got = counts.toArrow()  # at most MOST_LANGUAGES * BUCKETS rows
    langs = sorted(set(got["lang"].to_pylist()))
    index = {x: i for i, x in enumerate(langs)}
    model = np.zeros((len(langs), BUCKETS))
    if langs:
        model[[index[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
    model += SMOOTHING
    return langs, np.log(model / model.sum(1, keepdims=True)).astype(np.float32)


def word_likelihoods(texts: list[bytes], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each word in each language, for all texts in turn, and the words of each text."""
    buf = np.frombuffer(b"".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(x) for x in texts])
    bucket, real = grams(buf)
    first = np.nonzero((buf[2:] != 32) & (buf[1:-1] == 32))[0]  # of each word, as index into bucket
    per = np.diff(np.searchsorted(first, np.concatenate([[0], ends - 2]), side="left")) if len(first) else np.zeros(len(texts), int)
    if not len(first):
        return np.zeros((0, len(model)), np.float32), per
    out = np.empty((len(first), len(model)), np.float32)
    for k, row in enumerate(model):
        out[:, k] = np.add.reduceat(np.where(real, row[bucket], np.float32(0)), first)
    return out, per


def infer(ll: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of each text's main language (-1: no word), its estimated proportion, who is in its set, and the text's log likelihood by it.

    Nested sets, by proportion, grow as long as the penalised likelihood rises.
    """
    n, langs = len(per), ll.shape[1]
    main, share, member, fitness = np.full(n, -1), np.zeros(n), np.zeros((n, langs), bool), np.zeros(n)
    has = np.nonzero(per)[0]
    if not len(has) or not langs:
        return main, share, member, fitness
    top = ll.max(1, keepdims=True)
    like, words = np.exp(ll - top).astype(np.float64) + 1e-30, per[has]
    starts, owner = np.concatenate([[0], np.cumsum(words)[:-1]]), np.repeat(np.arange(len(has)), words)

    def fit(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pi = allowed / allowed.sum(1, keepdims=True)
        for _ in range(STEPS):
            part = like * pi[owner]
            part /= part.sum(1, keepdims=True)
            pi = np.add.reduceat(part, starts) / words[:, None]
        return pi, np.add.reduceat(np.log((like * pi[owner]).sum(1)), starts)

    full, _ = fit(np.ones((len(has), langs)))
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    chosen, best = full.copy(), np.full(len(has), -np.inf)
    rising = np.ones(len(has), bool)
    for k in range(1, langs + 1):
        pi, fitted = fit((rank < k).astype(float))
        fitted = fitted - SET_PENALTY * (k - 1) * np.log(words + 1)
        rising &= fitted > best
        if not rising.any():
            break
        best[rising], chosen[rising] = fitted[rising], pi[rising]
        member[has[rising]] = rank[rising] < k
    main[has] = chosen.argmax(1)
    share[has] = np.clip(full[np.arange(len(has)), main[has]], 0, 1)
    fitness[has] = np.add.reduceat(np.log((like * chosen[owner]).sum(1)) + top[:, 0], starts)
    return main, share, member, fitness


def identify(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the main language's proportion), ``langs`` (its set) and ``fit``; such columns are replaced, in any case.

    ``fit`` is the mean log likelihood of the text's trigrams by its mixture, over that of trigrams that are all as likely: below 0,
    what was learned says less of the text than nothing would.

    Only ``text`` is an input. ``und`` with score 0, no set and a null fit: null text, no letter, or nothing was learned. Whole texts
    are read, about ``CHUNK`` bytes at once, a longer text alone. Ties go to the first language in order.
    Repeated rows are identified each; an empty table gives no rows; other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))  # at most MOST_LANGUAGES rows of BUCKETS floats
    row, columns = apart(docs, "lang_pred", "score", "langs", "fit")
    at = [c.lower() for c in docs.columns].index("text")
    marked = docs.select(row, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, model = shared.value
        for b in batches:
            main, share, fit, sets = np.full(b.num_rows, -1), np.zeros(b.num_rows), np.full(b.num_rows, np.nan), [[] for _ in range(b.num_rows)]
            text, letters = b.column(0).field(at), b.column(1)
            rows, texts, size = [], [], 0

            def score() -> None:
                if rows:
                    ll, per = word_likelihoods(texts, model)
                    main[rows], share[rows], member, fitness = infer(ll, per)
                    # A word has a trigram for each of its bytes and one for its end.
                    size = np.array([len(x) - x.count(b" ") for x in texts]) + per
                    fit[rows] = np.where(main[rows] >= 0, fitness / np.maximum(size, 1) + np.log(BUCKETS), np.nan)
                    for i, x in zip(rows, member, strict=True):
                        sets[i] = [langs[k] for k in np.nonzero(x)[0]]

            for i in np.nonzero(letters.to_numpy(zero_copy_only=False))[0].tolist():
                rows.append(i)
                texts.append(folded(text[i].as_py()))
                size += len(texts[-1])
                if size >= CHUNK:
                    score()
                    rows, texts, size = [], [], 0
            score()
            names = np.array([*langs, UNKNOWN], object)[main]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(share), pa.array(sets, pa.list_(pa.string())), pa.array(fit, mask=np.isnan(fit))], names=["row", *made])

    made = ["lang_pred", "score", "langs", "fit"]
    schema = StructType([marked.schema["row"]]).add("lang_pred", "string").add("score", "double").add("langs", ArrayType(StringType())).add("fit", "double")
    return marked.mapInArrow(lean(run), schema).select(*columns, *made)


def crc_mod(doc_id: str | Column, by: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % by, F.lit(-1)) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % by


def language_of(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """Learn from the documents outside the fold (a null doc_id teaches nothing) and identify all."""
    training = docs.where(~crc_mod("doc_id", folds).isin(fold, -1))
    return identify(docs, *learn(training)).withColumn("held_out", crc_mod("doc_id", folds) == fold)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_of(docs).select("doc_id", "held_out", "lang_pred", "score")
