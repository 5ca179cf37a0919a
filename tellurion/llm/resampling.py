"""Resampling of documents towards a target distribution by importance of hashed features.

Features are runs of one or two words, hashed to buckets by CRC-32. The vocabulary has a head and a tail: words that are
frequent in all documents are counted exactly and sent to every task with their CRC states, from which a pair goes on
without reading its first word again, and frequent pairs with their buckets. Any other feature's CRC is computed where
it stands. Both feed the same exact totals a bucket, of the documents and of the target, and a document's weight is the
mean of its features' log ratios. Gumbel noise by ``doc_id`` turns the highest scores into a weighted draw.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm._util import cut, free, table
from tellurion.llm._words import chunks

BUCKETS = 10_000
#: A word (or pair) is of the head if it is at least one in so many of all, so the head has so many at most. The tail takes all others, and no result depends on it.
HEAD_WORDS, HEAD_PAIRS = 1 << 17, 1 << 17
#: Features longer than this (in bytes) are left to the tail.
HEAD_BYTES = 64
#: Different features that a task counts before it hands on what it has; documents that can be drawn have this many words.
HELD, LEAST_WORDS = 1 << 18, 20
SEED = 2024
#: A-Z to a-z; what is no letter, digit or byte of another script to a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class _States(dict):
    """CRC states of words: those of the head are there, the tail's are computed and not kept."""

    def __missing__(self, word: bytes) -> int:
        return crc32(word)


class _Pairs(dict):
    """Buckets of pairs: those of the head are there, another goes on from its first word's state."""

    def __init__(self, head: dict, states: _States, buckets: int):
        super().__init__(head)
        self.states, self.buckets = states, buckets

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return crc32(b" " + pair[1], self.states[pair[0]]) % self.buckets


class Vocabulary:
    """Buckets of a text's features by head and tail."""

    def __init__(self, head: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int):
        states = _States((w, crc32(w)) for w in head)
        self.state, self.buckets = states.__getitem__, buckets
        self.pair = _Pairs({p: crc32(b" " + p[1], states[p[0]]) % buckets for p in pairs}, states, buckets).__getitem__

    def of(self, words: list[bytes], most: int) -> np.ndarray:
        found = np.fromiter(map(self.state, words), np.int64, len(words)) % self.buckets
        if most < 2 or len(words) < 2:
            return found
        return np.concatenate([found, np.fromiter(map(self.pair, zip(words, words[1:], strict=False)), np.int64, len(words) - 1)])


def _counts(texts: DataFrame, features: Callable[[list[bytes]], Iterator], kinds: int) -> DataFrame:
    """``w0.., n``: how often each feature of ``texts(text)`` occurs, summed in tasks and then by feature."""
    names = [f"w{k}" for k in range(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def batch() -> pa.RecordBatch:
            cols = [seen] if kinds == 1 else zip(*seen, strict=True)
            out = pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.binary()) for c in cols), pa.array(list(seen.values()), pa.int64())], names=[*names, "n"])
            seen.clear()
            return out

        for b in batches:
            for part, found in chunks(iter([b]), 0):
                seen.update(chain.from_iterable(features(words(t)) for t in found))
                if len(seen) >= HELD:
                    yield batch()
        if seen:
            yield batch()

    counted = texts.select(F.col("text").cast("binary")).mapInArrow(run, ", ".join(f"{c} binary" for c in names) + ", n long")
    return counted.where(" and ".join(f"length({c}) <= {HEAD_BYTES}" for c in names)).groupBy(*names).agg(F.sum("n").alias("n"))


def head(docs: DataFrame, most: int, limit: int, pair_limit: int = 0) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    """The frequent words of ``docs(text)`` and, if ``most`` is 2, the frequent pairs of these, by exact counts.

    At most ``limit`` words and ``pair_limit`` pairs of bounded length reach the driver.
    """

    def frequent_of(counted: DataFrame, limit: int) -> list:
        counts = cut(counted)
        total = counts.agg(F.sum("n")).first()[0] or 0
        rows = counts.where(F.col("n") * limit >= total).drop("n").collect()
        free(counts)
        return [tuple(map(bytes, r)) for r in rows]

    frequent = [w for (w,) in frequent_of(_counts(docs, lambda w: w, 1), limit)]
    if most < 2:
        return frequent, []
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(frequent))  # at most limit words of HEAD_BYTES

    def pairs(w: list[bytes]) -> Iterator:
        known = sent.value
        return (p for p in zip(w, w[1:], strict=False) if p[0] in known and p[1] in known)

    return frequent, frequent_of(_counts(docs, pairs, 2), pair_limit)


def totals(texts: DataFrame, vocabulary, most: int, buckets: int) -> np.ndarray:
    """Features of all ``texts(text)`` by bucket, exactly. A task hands on one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, sums = vocabulary(), np.zeros(buckets, np.int64)
        for _, found in chunks(batches, 0):
            sums += np.bincount(np.concatenate([v.of(words(t), most) for t in found]), minlength=buckets)
        at = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col("text").cast("binary")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's log ratio of target to raw, smoothed by one a bucket, in thousandths."""
    s, t = float(raw.sum()) + len(raw), float(target.sum()) + len(raw)
    return np.array([math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(raw.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def ranked(scored: DataFrame, eligible, share: tuple[int, int]) -> DataFrame:
    """``scored(doc_id, score, ...)`` with ``rank``, 1 for the highest score, of the first ``share`` of the eligible rows.

    Rows are sorted over all tasks by score, ``doc_id`` and where they lay, so that equal ones are split, too. What
    reaches the driver is how many rows each sorted part has.
    """
    spark = scored.sparkSession
    rows = cut(scored.withColumns({"_row": F.monotonically_increasing_id(), "_out": ~eligible}))
    draw = rows.where(~F.col("_out")).count() * share[0] // share[1]
    order = ["_out", F.desc("score"), F.asc_nulls_last("doc_id"), "_row"]
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    free(rows)
    part, parts = F.shiftrightunsigned("_at", 33), []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a task
        parts.append((r["part"], parts[-1][2] if parts else 0, (parts[-1][2] if parts else 0) + r["count"]))
    start = F.broadcast(spark.createDataFrame(parts, "part long, start long, end long").drop("end"))
    rank = F.col("start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    met = placed.withColumn("part", part).join(start, "part").withColumn("rank", rank)
    return met.withColumn("rank", F.when(~F.col("_out") & (F.col("rank") <= draw), F.col("rank"))).drop("part", "start", "_row", "_out", "_at")


def resample(docs: DataFrame, target: DataFrame, most: int = 2, buckets: int = BUCKETS, share: tuple[int, int] = (10, 100), least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs(doc_id, text)``, drawn towards ``target(text)``.

    Features are all runs of one to ``most`` (1 or 2) words. ``weight`` is the floored mean gain of a document's features
    (none: 0), ``score`` that and Gumbel noise from the seed and ``doc_id``. Of the documents with at least ``least`` words, the floored
    ``share`` of highest scores is drawn and ranked, ties to the smaller ``doc_id``; all others have a null ``rank``.

    Null and wordless text has no feature. A null ``doc_id`` has a null score and is drawn last. Rows that repeat are
    documents of their own with equal scores. Texts of any length are read whole. An empty ``docs`` gives no rows,
    an empty ``target`` gains from smoothing alone. Other columns are not read.
    """
    if most not in (1, 2):
        raise ValueError("features have one or two words")
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(head(docs, most, HEAD_WORDS, HEAD_PAIRS))
    kept: list[Vocabulary] = []

    def vocabulary() -> Vocabulary:
        if not kept:
            kept.append(Vocabulary(*sent.value, buckets))
        return kept[0]

    gain = gains(totals(docs, vocabulary, most, buckets), totals(target, vocabulary, most, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary()
        for part, found in chunks(batches):
            rows = []
            for t in found:
                w = words(t)
                at = v.of(w, most)
                rows.append((len(w), len(at), int(gain[at].sum()) // len(at) if len(at) else 0))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=["doc_id", "n_words", "n_features", "weight"])

    weighed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    return ranked(weighed.withColumn("score", F.col("weight") + noise), F.col("n_words") >= least, share).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=1).drop("n_words")


#: CRC-32 is folded over the bytes by the table that its polynomial gives; each different word once.
OP12_SQL = r"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
  d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
  b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
  u AS (SELECT doc_id, unnest(ws) AS w FROM d),
  v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM u UNION SELECT w FROM b)),
  y AS (SELECT w, list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda k: CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT))) AS bytes FROM v),
  h AS (SELECT w, xor(list_reduce(bytes, lambda c, k: xor(c >> 8, tab[(xor(c, k) & 255) + 1])), 4294967295) % 10000 AS bucket FROM y, crc),
  s AS (SELECT bucket, count(*) AS n FROM u JOIN h USING (w) GROUP BY bucket),
  t AS (SELECT bucket, count(*) AS n FROM b JOIN h USING (w) GROUP BY bucket),
  g AS (SELECT h.w, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM u) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE))) AS BIGINT) AS gain
        FROM h LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
  m AS (SELECT doc_id, sum(gain) AS total FROM u JOIN g USING (w) GROUP BY doc_id),
  f AS (SELECT d.doc_id, len(ws) AS n_features, coalesce(CAST(floor(total::DOUBLE / len(ws)) AS BIGINT), 0) AS weight, CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (doc_id)),
  o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM f),
  r AS (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS k, 10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS draw FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= draw THEN k END AS rank FROM r
"""
