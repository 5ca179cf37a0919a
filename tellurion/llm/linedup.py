"""Line deduplication by pairwise alignment.

Documents that share a rare line or a run of lines are found through hashes. Each later document is aligned
with the first holder of each such line or run by patience diff: equal heads and tails are aligned, lines unique
in both sides anchor the rest in the order of their longest increasing run, and the gaps between anchors are
aligned likewise; a gap without anchors is cut at its longest common block. Aligned common blocks go from the
later document. A first holder is never later than another holder, so one copy of all text stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm._joins import counted_join, spread_join
from tellurion.llm._util import apart, cut, free, lean, table
from tellurion.llm._words import stirred

#: A line that is rare by itself has so many words: with fewer, chance and layout repeat it. How many documents
#: hold it sets no limit, as each holder is paired with the first one only.
RARE_WORDS = 6
#: A common block is deleted from so many words on. Runs of lines of so many words in sum, however short each
#: line, find documents too: a block that is equal in both sides holds the run from its first line on, so no block
#: that may be deleted is missed for the length of its lines.
BLOCK_WORDS = 12
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


def line_table(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word count of each ``\\n``-split line, ends trimmed; a blank line has hash 0."""
    from xxhash import xxh64_intdigest

    lines = [x.split() for x in text.split(b"\n")]
    return np.array([xxh64_intdigest(b" ".join(x)) | 1 if x else 0 for x in lines], np.uint64).view(np.int64), np.array([len(x) for x in lines], np.int32)


class _Spans:
    """Hashes of ranges of lines: equal ranges have equal hashes."""

    def __init__(self, lines: np.ndarray):
        powers, self.back = (np.concatenate([[np.uint64(1)], np.full(len(lines), x, np.uint64)]).cumprod(dtype=np.uint64) for x in (_ODD, _BACK))
        self.sums = np.concatenate([[np.uint64(0)], (lines.view(np.uint64) * powers[:-1]).cumsum(dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return stirred((self.sums[ends] - self.sums[starts]) * self.back[starts])


def run_keys(lines: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Distinct hashes of the lines of ``RARE_WORDS``, and of the shortest runs of ``BLOCK_WORDS`` in sum from each line with a word on."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    starts = np.nonzero(words)[0]
    ends = np.searchsorted(total, total[starts] + BLOCK_WORDS)
    starts, ends = starts[ends <= len(lines)], ends[ends <= len(lines)]
    several = (ends - starts > 1) | (words[starts] < RARE_WORDS)
    runs = _Spans(lines).of(starts[several], ends[several]).view(np.int64)
    return np.unique(np.concatenate([lines[words >= RARE_WORDS], runs]))


def _increasing(pa_: list[int], pb: list[int]) -> list[tuple[int, int]]:
    """The longest run of pairs that increases in both sides; ``pb`` is in order."""
    tails, at, back = [], [], [-1] * len(pb)
    for k, x in enumerate(pa_):
        j = bisect_left(tails, x)
        back[k] = at[j - 1] if j else -1
        tails[j : j + 1], at[j : j + 1] = [x], [k]
    anchors, k = [], at[-1] if at else -1
    while k >= 0:
        anchors.append((pa_[k], pb[k]))
        k = back[k]
    return anchors[::-1]


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Starts in ``a`` and ``b`` and length of a longest common block whose first line has a word."""
    sa, sb, best = _Spans(a), _Spans(b), (0, 0, 0)
    fa, fb, lo, hi = np.nonzero(a)[0], np.nonzero(b)[0], 1, min(len(a), len(b))
    while lo <= hi:
        n = (lo + hi) // 2
        ia, ib = fa[fa + n <= len(a)], fb[fb + n <= len(b)]
        _, xa, xb = np.intersect1d(sa.of(ia, ia + n), sb.of(ib, ib + n), return_indices=True)
        same = next(((int(ia[i]), int(ib[j])) for i, j in zip(xa, xb, strict=True) if np.array_equal(a[ia[i] : ia[i] + n], b[ib[j] : ib[j] + n])), None)
        if same:
            best, lo = (*same, n), n + 1
        else:
            hi = n - 1
    return best


def _agreeing(same: np.ndarray) -> int:
    """How many are true before the first that isn't."""
    return len(same) if same.all() else int(same.argmin())


def patience_blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of ``b`` that a patience diff aligns with equal lines of ``a``."""
    met, gaps = np.zeros(len(b) + 2, np.int8), [(0, len(a), 0, len(b))]
    while gaps:
        la, ha, lb, hb = gaps.pop()
        n = min(ha - la, hb - lb)
        n = _agreeing(a[la : la + n] == b[lb : lb + n])
        met[lb + 1 : lb + n + 1] = 1
        la, lb = la + n, lb + n
        n = min(ha - la, hb - lb)
        n = _agreeing(a[ha - n : ha][::-1] == b[hb - n : hb][::-1])
        met[hb - n + 1 : hb + 1] = 1
        ha, hb = ha - n, hb - n
        if la == ha or lb == hb:
            continue
        va, ia, ca = np.unique(a[la:ha], return_index=True, return_counts=True)
        vb, ib, cb = np.unique(b[lb:hb], return_index=True, return_counts=True)
        shared, xa, xb = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
        xa, xb = xa[shared != 0], xb[shared != 0]
        if not len(xa):
            continue
        once = (ca[xa] == 1) & (cb[xb] == 1)
        pa_, pb = la + ia[xa[once]], lb + ib[xb[once]]
        order = np.argsort(pb)
        cuts = [(x, y, 1) for x, y in _increasing(pa_[order].tolist(), pb[order].tolist())]
        if not cuts:
            x, y, n = _longest(a[la:ha], b[lb:hb])
            cuts = [(la + x, lb + y, n)]
        for x, y, n in cuts:
            met[y + 1 : y + n + 1] = 1
            gaps.append((la, x, lb, y))
            la, lb = x + n, y + n
        gaps.append((la, ha, lb, hb))
    step = np.diff(met)
    return list(zip(np.nonzero(step == 1)[0].tolist(), np.nonzero(step == -1)[0].tolist(), strict=True))


def _tables(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [line_table(t.as_py() or b"") for t in b.column(1)]
            arrays = [pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([run_keys(*r) for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", "lines", "words", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(lean(run), "doc_id long, lines array<long>, words array<int>, keys array<long>")


def _aligned(pairs: DataFrame) -> DataFrame:
    """``doc_id, gone``: numbers of the lines of the later document that one alignment deletes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, gone = [], []
            for doc_id, first, lines, words in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                first, lines, words = (x.values.to_numpy(zero_copy_only=False) for x in (first, lines, words))
                out = [k for s, e in patience_blocks(first, lines) if words[s:e].sum() >= BLOCK_WORDS for k in range(s, e) if words[k]]
                if out:
                    ids.append(doc_id)
                    gone.append(out)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "gone"])

    return pairs.select("doc_id", "first_lines", "lines", "words").mapInArrow(lean(run), "doc_id long, gone array<int>")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, gone``: a document's lines with a word, and the numbers (from 0) of those to delete."""
    tables = cut(_tables(docs))
    held, lined = cut(tables.select(F.explode("keys").alias("key"), "doc_id")), tables.drop("keys")
    firsts = cut(held.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last"))
    pairs = cut(counted_join(held, firsts, "key").where("first < doc_id").select("doc_id", "first").distinct())
    free(held, firsts)
    with_first = cut(spread_join(pairs, lined.select(F.col("doc_id").alias("first"), F.col("lines").alias("first_lines")), "first"))
    deleted = _aligned(spread_join(with_first, lined, "doc_id")).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    count = F.size(F.filter("words", lambda w: w > 0)).cast("long")
    return lined.select("doc_id", count.alias("n_lines")).join(deleted, "doc_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less its repeated blocks, ``n_lines`` and ``n_removed``.

    A block of lines common with an earlier document (by ``doc_id``) is deleted from 12 words on, as far as it
    is aligned with the first holder of one of its lines of at least 6 words or of a run of its lines of 12
    words in sum; lines are compared with white space folded.
    Judged on the input, so the result doesn't depend on order. ``doc_id`` is unique and not null: rows with
    a null one stay as they are, repeated ones are one document for the comparison. Null text stays null,
    empty text empty; a text of any length is one row; empty tables give none. Columns named ``n_lines`` and
    ``n_removed`` (in any case) are replaced, others kept, whatever their names.
    """
    row, columns = apart(docs, "n_lines", "n_removed")
    kept = docs.select(row, F.col("doc_id").alias("id"), F.col("text").alias("said"))
    known = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    found = repeated_lines(known)
    left = F.array_join(F.filter(F.split("said", "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    joined = kept.join(found, F.col("id") == F.col("doc_id"), "left")
    said = F.when(F.size("gone") > 0, left).otherwise(F.col("said"))
    given = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    columns = [said.alias(c) if c.lower() == "text" else x for c, x in zip(given, columns, strict=True)]
    return joined.select(*columns, F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op9_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
