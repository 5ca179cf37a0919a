"""Order-preserving packing of tokenised documents into fixed windows.

The token stream of a partition is cut by dynamic programming. ``best[j]``, the least cost of a cut at
candidate ``j``, is ``min(best[i] + padding(i, j)) + penalty[j]`` over candidates ``i`` at most one window
back. Padding is ``width - (pos[j] - pos[i])``, so the minimum of ``best[i] + pos[i]`` over a sliding range
is needed, which a monotone queue yields in constant time a step. Windows whose length is a power of two
need no padding; those transitions have one possible ``i`` each and are looked up.
"""

from __future__ import annotations

import re
import struct
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm._util import lean, table

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
EOD = 1
#: Cost of a cut, in padding tokens: after a sentence or line, inside a sentence after a word, inside a word.
SENTENCE_COST, WORD_COST, FORCED_COST = 4.0, 24.0, 64.0
#: Extra cost of an unpadded window shorter than the width, so that the stream isn't shredded.
BUCKET_COST, LEAST_BUCKET = 32.0, 256
#: Cuts inside a sentence are offered about every so many tokens.
WORD_STRIDE = 32
#: Tokens planned at once; the last window of a block is carried into the next.
BLOCK_TOKENS = 1 << 20


def _byte_letters() -> dict[int, str]:
    """Latin-1 letters as the byte-level alphabet writes their two UTF-8 bytes: bytes without a glyph follow 255 in order."""
    bare = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    glyph = {b: chr(256 + bare.index(b)) if b in bare else chr(b) for b in range(256)}
    return {c: "".join(glyph[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class _Kept(dict):
    """A dictionary that fills itself by ``make``. Once it holds ``LIMIT`` keys, those not met again since the last such change of generation are forgotten."""

    LIMIT, LONG = 400_000, 64

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.LONG:
            if len(self) >= self.LIMIT:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordIds:
    """Ids of texts as little-endian uint32 bytes; frequent words and pieces are encoded once.

    White space never lies inside a token and the tokenizer cuts a text into pieces first, so a text's ids are
    those of its words, and a word's those of its pieces, in turn. Texts of ASCII and Latin-1 letters are cut
    here by the tokenizer's own rule, which leaves only the byte-pair merges to do; the words of other texts, and of
    those in which a token added to the vocabulary is spelt out, go through the whole tokenizer. Should a tokenizer
    have added tokens with white space in them, texts that hold one go through it whole.
    """

    LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
    PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")
    OTHER = re.compile("[^\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
    BYTES = _byte_letters()

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        merge, cut = tokenizer.model.tokenize, self.PIECE.findall

        def packed(ids: list[int]) -> bytes:
            return struct.pack(f"<{len(ids)}I", *ids)

        def ids(word: str) -> bytes:
            # Letters are one piece, and most other words are letters and a mark. Pieces are kept among the words, many of which they are.
            if word.isalpha():
                return packed([t.id for t in merge(word if word.isascii() else word.translate(self.BYTES))])
            found = [word[:-1], word[-1]] if word[:-1].isalpha() else cut(word)
            return b"".join(map(self.plain.__getitem__, found)) if len(found) > 1 else packed([t.id for t in merge(word)])

        self.plain = _Kept(ids)
        self.any = _Kept(lambda word: packed(tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids))
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.wide = re.compile("|".join(re.escape(x) for x in added if x.split() != [x]) or "(?!)")

    def lines(self, text: bytes) -> list[bytes]:
        """The ids of each line."""
        plain = text.decode("utf-8", "replace")
        if self.wide.search(plain):
            return [self.any.make(text)]
        lines, find = (text, self.any) if self.OTHER.search(plain) or self.added.search(plain) else (plain.lower(), self.plain)
        return [b"".join(map(find.__getitem__, line.split())) for line in lines.split(b"\n" if lines is text else "\n")]


@lru_cache(1)
def _word_ids(path: str) -> WordIds:
    """One a Python worker, so that a task finds the words of the tasks before it encoded."""
    return WordIds(path)


@lru_cache(1)
def _ending_ids(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Boolean tables by id: the token ends a word; the token ends a sentence."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab()
    word, sentence = np.zeros(max(vocab.values()) + 2, bool), np.zeros(max(vocab.values()) + 2, bool)
    for token, i in vocab.items():
        word[i] = token.endswith("</w>")
        sentence[i] = word[i] and token[:-4][-1:] in (".", "!", "?")
    return word, sentence


def plan_cuts(pos: np.ndarray, penalty: np.ndarray, width: int) -> list[int]:
    """Indices into ``pos`` (ascending, from 0, gaps at most ``width``) of the cheapest cuts, first and last included."""
    sizes = [1 << k for k in range(LEAST_BUCKET.bit_length() - 1, width.bit_length()) if 1 << k < width]
    exact: dict[int, list[int]] = {}
    for size in sizes:
        at = np.searchsorted(pos, pos - size)
        hit = np.nonzero((pos >= size) & (pos[np.minimum(at, len(pos) - 1)] == pos - size))[0]
        for j, i in zip(hit.tolist(), at[hit].tolist(), strict=True):
            exact.setdefault(j, []).append(i)
    p, pen = pos.tolist(), penalty.tolist()
    best, key, back = [0.0] * len(p), [0.0] * len(p), [0] * len(p)
    queue = deque([0])
    for j in range(1, len(p)):
        here = p[j]
        while p[queue[0]] < here - width:
            queue.popleft()
        i = queue[0]
        cost = key[i] + width - here
        for e in exact.get(j, ()):
            if best[e] + BUCKET_COST < cost:
                cost, i = best[e] + BUCKET_COST, e
        cost += pen[j]
        best[j], back[j] = cost, i
        key[j] = cost = cost + here
        while queue and key[queue[-1]] >= cost:
            queue.pop()
        queue.append(j)
    cuts = [len(p) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def candidates(ids: np.ndarray, lines: np.ndarray, docs: np.ndarray, word: np.ndarray, sentence: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions and their costs. ``lines`` and ``docs`` hold the stream positions after lines and documents."""
    known = np.minimum(ids, len(word) - 1)
    ends = np.nonzero(word[known])[0] + 1
    ends = ends[np.diff(ends // WORD_STRIDE, prepend=0) > 0]
    at = np.concatenate([[0], ends, np.nonzero(sentence[known])[0] + 1, lines, docs])
    cost = np.concatenate([[0.0], np.full(len(ends), WORD_COST), np.full(len(at) - 1 - len(ends) - len(docs), SENTENCE_COST), np.zeros(len(docs))])
    order = np.lexsort((cost, at))
    at, cost = at[order], cost[order]
    first = np.diff(at, prepend=-1) > 0
    at, cost = at[first], cost[first]
    step = width // 4
    wide = np.nonzero(np.diff(at) > step)[0]
    if len(wide):
        more = np.concatenate([np.arange(at[i] + step, at[i + 1], step) for i in wide])
        at, cost = np.concatenate([at, more]), np.concatenate([cost, np.full(len(more), FORCED_COST)])
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    return at, cost


class _Packer:
    def __init__(self, path: str, width: int, partition: int):
        self.words, (self.word_end, self.sentence_end) = _word_ids(path), _ending_ids(path)
        self.width, self.next_id = width, partition << 33
        self.clear()

    def clear(self) -> None:
        self.parts: list[np.ndarray] = []  # ids
        self.lines: list[np.ndarray] = []
        self.pieces: list[tuple] = []  # doc_id, start in the document, length, document's tokens
        self.size = 0

    def add(self, doc_id, text: bytes) -> None:
        parts = self.words.lines(text)
        ids = np.frombuffer(b"".join(parts), "<u4")
        ids = np.append(ids, np.uint32(EOD))
        ends = np.cumsum([len(x) >> 2 for x in parts])
        self.lines.append(self.size + ends[ends > 0])
        self.parts.append(ids)
        self.pieces.append((doc_id, 0, len(ids), len(ids)))
        self.size += len(ids)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.size:
            return
        ids, lines = np.concatenate(self.parts), np.concatenate(self.lines)
        pieces = self.pieces
        starts = np.cumsum([0, *(x[2] for x in pieces)])
        at, cost = candidates(ids, lines, starts[1:], self.word_end, self.sentence_end, self.width)
        cuts = at[plan_cuts(at, cost, self.width)].tolist()
        keep = cuts[-1] if last else cuts[-2]
        k, starts = 0, starts.tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a >= keep:
                break
            x = a
            while x < b:
                doc_id, start, length, tokens = pieces[k]
                y = min(b, starts[k] + length)
                yield doc_id, start + x - starts[k], y - x, tokens, self.next_id, x - a, ids[x:y].tobytes()
                if y == starts[k] + length:
                    k += 1
                x = y
            self.next_id += 1
        self.clear()
        if keep < len(ids):
            doc_id, start, length, tokens = pieces[k]
            done = keep - starts[k]
            self.pieces = [(doc_id, start + done, length - done, tokens), *pieces[k + 1 :]]
            self.parts, self.lines, self.size = [ids[keep:].copy()], [lines[lines > keep] - keep], len(ids) - keep


def pack(docs: DataFrame, tokenizer: str, width: int = 2048) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into windows of at most ``width`` tokens; one row per piece of a document.

    Each partition packs its own rows in their stored order, so nothing is shuffled and a window never waits
    for another task. A document's ids are those of its text and then ``EOD``. ``sequence_id`` is unique over
    partitions, ``offset`` gapless in the window; ``ids`` holds little-endian uint32 ids. A null or empty text
    is a document of the one id ``EOD``; a null ``doc_id`` stays null; repeated rows are packed as often as
    they occur; an empty table gives no rows; other columns are not read. A text of any length is cut at its
    own boundaries; its ids and at most one block of others are in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out = _Packer(tokenizer, width, TaskContext.get().partitionId()), []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(doc_id, text.as_py() or b"")
                if packer.size >= BLOCK_TOKENS:
                    out = list(packer.flush(last=False))
                    if out:
                        yield batch(out)
        out = list(packer.flush(last=True))
        if out:
            yield batch(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(lean(run), SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
