"""Removal of word passages that an earlier document holds, by suffix automata and matching statistics.

The reference is the corpus itself and has no size bound, so the automata of its shards are not broadcast: each lies
with the documents that can match it. Hashes of windows tell who these are. The first holder of each repeated
window gives the passage around it to the reference, which so holds every repeated passage once; passages are
dealt to shards of bounded size. Of a document, what is streamed past a shard's automaton is the stretches whose
windows begin there earlier. Matching statistics give the maximal common spans; those of at least ``WINDOW``
words are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm._joins import counted_join
from tellurion.llm._util import cut, free, join_small, table
from tellurion.llm._words import chunks, range_codes, run_codes, word_codes

WINDOW = 13
#: Words of an anchor. A window's anchor is the least hash of its anchors' places; equal windows agree on it.
ANCHOR = 4
#: Words of a shard's passages, about, and words that are streamed past one copy of its automaton. A first holder's
#: passages are dealt by parts of so many words, so that a long one is spread over shards, too.
SHARD, STREAM, PART = 1 << 16, 1 << 18, 1 << 12


def window_anchors(code: np.ndarray) -> np.ndarray:
    """The anchor of the window that starts at each word."""
    x, width, left = run_codes(code, ANCHOR), 1, WINDOW - ANCHOR + 1
    while width < left:
        step = min(width, left - width)
        x, width = np.minimum(x[: max(0, len(x) - step)], x[step:]), width + step
    return x


def _starts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every word where a window starts that ends in the same text: its index over all texts, and its text."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.nonzero(np.arange(len(owner)) + WINDOW <= at[owner + 1])[0]
    return first, owner[first]


class Automaton:
    """Suffix automaton of passages of words: the states' transitions, suffix links and longest lengths.

    Passages are parted by numbers, which are no words, so no match runs over an end.
    """

    def __init__(self, passages: list[list[bytes]]):
        go, link, size = [{}], [-1], [0]
        last = 0
        for c in chain.from_iterable((*words, k) for k, words in enumerate(passages)):
            new = len(go)
            go.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = new
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if size[p] + 1 == size[q]:
                    link[new] = q
                else:
                    twin = len(go)
                    go.append(dict(go[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.go, self.link, self.size = go, link, size

    def matching(self, words: list[bytes]) -> np.ndarray:
        """Length of the longest match that ends at each word."""
        go, link, size = self.go, self.link, self.size
        out, state, n = np.zeros(len(words), np.int64), 0, 0
        for i, c in enumerate(words):
            while state and c not in go[state]:
                state = link[state]
                n = size[state]
            if c in go[state]:
                state, n = go[state][c], n + 1
            out[i] = n
        return out


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Maximal spans (start, end) of ``n`` words that these ranges cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    edge = np.diff((np.cumsum(step) > 0).astype(np.int8), prepend=0)
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True))


def _anchored(docs: DataFrame) -> DataFrame:
    """``doc_id, value``: the anchors of a document's windows, a run of equal ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in chunks(batches):
            code, at = word_codes(texts)
            first, owner = _starts(at)
            value = window_anchors(code)[first]
            new = np.concatenate([[True], (np.diff(owner) != 0) | (value[1:] != value[:-1])])[: len(value)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner[new])), pa.array(value[new].view(np.int64))], names=["doc_id", "value"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, value long")


def _blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end, value, windows``: stretches of ``docs(doc_id, text, shared)`` whose windows, one after
    the other, have the same shared anchor; their bounds, hash, and the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in chunks(batches):
            code, at = word_codes(texts)
            first, owner = _starts(at)
            anchor = window_anchors(code)[first]
            shared = np.unique(b.column(2).flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
            hit = np.isin(anchor, shared)
            first, owner, anchor = first[hit], owner[hit], anchor[hit]
            new = np.concatenate([[True], (np.diff(first) != 1) | (np.diff(owner) != 0) | (anchor[1:] != anchor[:-1])])[: len(first)]
            opens = np.nonzero(new)[0]
            closes = np.append(opens[1:], len(first)) - 1 if len(opens) else opens
            start, end = first[opens], first[closes] + WINDOW
            value = range_codes(code, start, end).view(np.int64)
            windows = pa.ListArray.from_arrays(pa.array(np.append(opens, len(first)), pa.int32()), pa.array(run_codes(code, WINDOW)[first].view(np.int64)))
            origin = at[owner[opens]]
            arrays = [b.column(0).take(pa.array(owner[opens])), pa.array((start - origin).astype(np.int32)), pa.array((end - origin).astype(np.int32)), pa.array(value), windows]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "end", "value", "windows"])

    return docs.select("doc_id", F.col("text").cast("binary"), "shared").mapInArrow(run, "doc_id long, start int, end int, value long, windows array<long>")


def _firsts(held: DataFrame) -> DataFrame:
    """``value, first, n``: the first holder of each value that several documents hold, and its rows; and ``at``, a place there, if rows have a ``start``."""
    place = [F.min_by("start", "doc_id").alias("at")] if "start" in held.columns else []
    return held.groupBy("value").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"), *place).where("first < last").drop("last")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end, first, at``: words that several documents hold in windows, a first holder of them and where they are there.

    Equal stretches go first. What no earlier document holds as a stretch is looked up window by window.
    """
    marks = cut(_anchored(docs))
    meant = cut(_firsts(marks).drop("first"))
    shared = cut(counted_join(marks, meant, "value").groupBy("doc_id").agg(F.collect_set("value").alias("shared")))
    free(marks, meant)
    blocks = cut(_blocks(docs.join(shared, "doc_id")))
    firsts = cut(_firsts(blocks))
    placed = cut(counted_join(blocks, firsts, "value", "left").select("doc_id", "start", "end", "first", "at", F.when(F.coalesce(F.col("first") == F.col("doc_id"), F.lit(True)), F.col("windows")).alias("windows")))
    free(shared, blocks, firsts)
    held = cut(placed.where("windows is not null").select("doc_id", "start", F.posexplode("windows").alias("step", "value")).select("doc_id", (F.col("start") + F.col("step")).alias("start"), "value"))
    firsts = cut(_firsts(held))
    single = counted_join(held, firsts, "value").select("doc_id", "start", (F.col("start") + WINDOW).alias("end"), "first", "at")
    out = cut(placed.where("first is not null").select("doc_id", "start", "end", "first", "at").unionByName(single))
    free(placed, held, firsts)
    return out


def _passages(docs: DataFrame, ranges: DataFrame, shards: int) -> DataFrame:
    """``shard, given, doc_id, start, words``: passages that first holders give (true), and stretches to match."""
    # Shard and role in one number, so that a document's ranges come in order of them.
    place = 2 * F.pmod(F.xxhash64("first", F.floor(F.col("at") / PART)), F.lit(shards)) + (F.col("first") == F.col("doc_id")).cast("long")
    at = F.shiftleft(place, 32) + F.col("start")
    per = ranges.groupBy("doc_id").agg(F.collect_list(at).alias("at"), F.collect_list("end").alias("end"))
    names = ["shard", "given", "doc_id", "start", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in chunks(batches):
            out = []
            for i, text in enumerate(texts):
                words = text.split()
                at, end = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (2, 3))
                place, start = at >> 32, at & 0xFFFFFFFF
                for g in np.unique(place).tolist():
                    mine = place == g
                    out += [(g >> 1, bool(g & 1), i, s, b" ".join(words[s:e])) for s, e in covered(start[mine], end[mine], len(words))]
            shard, given, row, start, said = zip(*out, strict=True) if out else [()] * 5
            arrays = [pa.array(shard, pa.int32()), pa.array(given, pa.bool_()), b.column(0).take(pa.array(row, pa.int32())), pa.array(start, pa.int32()), pa.array(said, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    texts = docs.dropDuplicates(["doc_id"]).select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.join(per, "doc_id").mapInArrow(run, "shard int, given boolean, doc_id long, start int, words binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: word bounds (start, end, start, end, ...) of what an earlier document holds."""
    ranges = repeated_ranges(docs)
    given = ranges.where(F.col("first") == F.col("doc_id")).agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    parts = cut(_passages(docs, ranges, max(1, -(-given // SHARD))))
    free(ranges)
    # A shard that many documents can match gets more copies, each with its own share of them.
    stretches = parts.where(~F.col("given"))
    size = cut(stretches.groupBy("shard").agg(F.ceil(F.sum(F.length("words")) / (8 * STREAM)).cast("int").alias("copies")))
    dealt = join_small(stretches, size, "shard").withColumn("copy", F.pmod(F.xxhash64("doc_id", "start"), "copies").cast("int")).drop("copies")
    references = join_small(parts.where("given"), size, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    met = dealt.unionByName(references).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.desc("given"), "doc_id", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, passages, automaton = None, [], None
        for b in batches:
            ids, spans = [], []
            for shard, copy, given, doc_id, start, said in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if (shard, copy) != place:
                    place, passages, automaton = (shard, copy), [], None
                words = said.split()
                if given:
                    passages.append(words)
                    continue
                automaton = automaton or Automaton(passages)
                ends = np.nonzero(automaton.matching(words) >= WINDOW)[0]
                ids.append(doc_id)
                spans.append([start + x for span in covered(ends - WINDOW + 1, ends + 1, len(words)) for x in span])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], names=["doc_id", "spans"])

    found = met.select("shard", "copy", "given", "doc_id", "start", "words").mapInArrow(run, "doc_id long, spans array<int>")
    out = cut(found.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    free(parts, size)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of ``docs(doc_id, text)``.

    Words are runs of anything but ASCII white space, unchanged. A word goes if a window of 13 consecutive
    words over it also starts in a document with a smaller ``doc_id``; judged on the input. What is kept is
    joined by single spaces. Which windows are equal is settled by 64-bit hashes of them and then by the words
    themselves, in the automaton; a window is missed only if its hash meets that of another in a still earlier
    document. Null and empty texts have no words. A repeated row gives a row each time, of one document (a
    ``doc_id`` has one text); a null ``doc_id`` is left out; empty tables give no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    whole = join_small(docs, repeated_spans(docs), "doc_id", "left").select("doc_id", F.col("text").cast("binary"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for t, found in zip(b.column(1), b.column(2), strict=True):
                words = (t.as_py() or b"").split()
                drop = np.zeros(len(words), bool)
                x = found.as_py() or ()
                for s, e in zip(x[::2], x[1::2], strict=True):
                    drop[s:e] = True
                n.append(len(words))
                gone.append(int(drop.sum()))
                kept.append(b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    out = whole.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
