"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is a path of binary decisions down a Huffman tree of the training text's bytes. Every decision has a context
tree over the last ``DEPTH`` bytes. A node's counts give the Krichevsky-Trofimov estimate; weighting mixes it half
and half with the product of the node's children, so that the probability of a bit mixes all depths. Counts are
gathered over all training text and then frozen. The tree grows with the text: every context seen ``LEAST`` times
has a node. It is counted, weighted and kept as Spark tables, by the two nearest bytes of a context, whose subtrees
are independent; texts are scored against as many bounded parts of it, one after the other, as it takes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm._util import cut, free, table
from tellurion.llm._words import FOLD, stirred, word_codes
from tellurion.llm.langid import crc_mod

#: Bytes of context; contexts of at most ``TOP`` bytes that were seen at all have a node, deeper ones if seen so often.
DEPTH, TOP, LEAST = 5, 2, 2
#: Ends a text; UTF-8 has no such byte.
END = 255
#: Bytes of the model's rows that are broadcast at once. A larger model takes more passes over the texts.
PART = 96 << 20
#: Text that is counted or scored at once.
CHUNK = 1 << 19
#: The words counted most in training, at most so many, are scored while scanning; the others by a join.
FREQUENT = 1 << 16
#: Distinct values that a task counts before it passes them on.
HELD = 2_000_000
_8 = np.uint64(8)


def folded(text: bytes) -> bytes:
    """Lower-cased A to Z."""
    return text.translate(FOLD)


class Alphabet:
    """Symbols of the bytes seen, in order, and of all others together; ``zero`` and ``one`` tell which symbols lie
    on either side of each binary decision. The other bytes part their symbol's probability alike."""

    def __init__(self, counts: np.ndarray):
        used = np.nonzero(counts)[0]
        self.size = len(used) + (len(used) < 256)
        self.code = np.full(256, self.size - 1, np.uint64)
        self.code[used] = np.arange(len(used))
        rare = np.full(256, -math.log10(max(1, 256 - len(used))))
        rare[used] = 0
        self.rare = rare
        leaves = np.zeros(self.size)
        leaves[: len(used)] = counts[used]
        self.zero, self.one = np.zeros((self.size, self.size - 1)), np.zeros((self.size, self.size - 1))
        heap = [(float(n), i, [i]) for i, n in enumerate(leaves)]
        heapq.heapify(heap)
        for k in range(self.size - 1):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            self.zero[a[2], k] = self.one[b[2], k] = 1
            heapq.heappush(heap, (a[0] + b[0], self.size + k, a[2] + b[2]))


def cells_of(texts: list[bytes], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte of the texts in turn and of their ends: the bytes before it, nearest first, and its symbol as one
    number; and where each text's cells begin, with the last bound."""
    sizes = np.array([len(x) for x in texts], np.int64)
    pad = bytes([END]) * DEPTH
    raw = np.frombuffer(pad + pad.join(texts) + pad[:1], np.uint8)
    out = np.zeros(len(raw) - DEPTH, np.uint64)
    for k in range(1, DEPTH + 1):
        out <<= _8
        out |= raw[DEPTH - k : len(raw) - k]
    out <<= _8
    out |= code[raw[DEPTH:]]
    starts = np.cumsum(np.concatenate([[0], sizes + DEPTH]))[:-1]
    keep = np.ones(len(out), bool)
    keep[(starts[1:, None] - 1 - np.arange(DEPTH - 1)).ravel()] = False  # ends after the first are context only
    return out[keep], np.concatenate([[0], np.cumsum(sizes + 1)])


_HALVES = np.concatenate([[math.lgamma(0.5)], math.lgamma(0.5) + np.cumsum(np.log(np.arange(4096) + 0.5))])
_WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4097)))])


def _log_gamma(x: np.ndarray, small: np.ndarray, shift: float) -> np.ndarray:
    """Of ``x + shift``; up to 4096 looked up, beyond by Stirling's series."""
    y = np.maximum(x, 4096) + shift
    return np.where(x <= 4096, small[np.minimum(x, 4096).astype(np.int64)], (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y))


def block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    out, some = np.zeros(zeros.shape), (zeros + ones) > 0
    a, b = zeros[some], ones[some]
    out[some] = _log_gamma(a, _HALVES, 0.5) + _log_gamma(b, _HALVES, 0.5) - _log_gamma(a + b, _WHOLES, 1.0) - math.log(math.pi)
    return out


class Subtree:
    """Contexts of depth ``top`` to ``DEPTH`` below one or all contexts of depth ``top``, from their cells in order."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, alphabet: Alphabet, top: int, least: int):
        self.alphabet, self.keys, self.parents, self.counts = alphabet, [], [], []
        symbol, context, size = (cells & np.uint64(255)).astype(np.int64), cells >> _8, alphabet.size
        for d in range(top, DEPTH + 1):
            key = context >> np.uint64(8 * (DEPTH - d))
            new = np.concatenate([[True], key[1:] != key[:-1]])
            row = np.cumsum(new) - 1
            keep = (np.bincount(row, counts) >= least) | (d <= TOP)
            at, hit = (np.cumsum(keep) - 1)[row], keep[row]
            self.counts.append(np.bincount(at[hit] * size + symbol[hit], counts[hit], int(keep.sum()) * size).reshape(-1, size))
            self.keys.append(key[new][keep])
            if d > top:
                self.parents.append(np.searchsorted(self.keys[-2], self.keys[-1] >> _8))

    def weigh(self, top_weight: np.ndarray | None = None) -> np.ndarray:
        """Log of the weighted probability of every decision's bits at the contexts of depth ``top``, a row each.

        What a context's children leave of its counts is one child of its own.
        """
        self.seen = [(c @ self.alphabet.zero, c @ self.alphabet.one) for c in self.counts]
        own = [block(*x) for x in self.seen]
        weight, self.shares = own[-1], [np.ones_like(own[-1])]
        if top_weight is not None:
            weight = top_weight
        for k in range(len(own) - 2, -1, -1):
            def summed(v: np.ndarray, up=self.parents[k], n=len(own[k])) -> np.ndarray:
                out, first = np.zeros((n, v.shape[1])), np.nonzero(np.diff(up, prepend=-1))[0]
                if len(first):
                    out[up[first]] = np.add.reduceat(v, first, axis=0)
                return out

            rest = [np.maximum(0, x - summed(y)) for x, y in zip(self.seen[k], self.seen[k + 1], strict=True)]
            below, some = summed(weight) + block(*rest), (self.seen[k][0] + self.seen[k][1]) > 0
            weight, share = np.zeros_like(below), np.ones_like(below)
            weight[some] = np.logaddexp(own[k][some], below[some]) - math.log(2)
            share[some] = np.exp(np.minimum(0, own[k][some] - math.log(2) - weight[some]))
            self.shares.insert(0, share)
        return weight

    def rows(self, above: np.ndarray, mixed: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, tuple]]:
        """By depth: log10 probabilities of the symbols after contexts that go no deeper, and what is handed down:
        the estimate above, the mixture so far and the weight left. The arguments are those of depth ``top - 1``."""
        for k, ((a, b), share) in enumerate(zip(self.seen, self.shares, strict=True)):
            if k:
                up = self.parents[k - 1]
                above, mixed, left = above[up], mixed[up], left[up]
            some = a + b > 0  # a context never seen has no estimate of its own and takes its parent's
            above = np.where(some, (b + 0.5) / (a + b + 1), above)
            p = np.clip(mixed + left * above, 1e-12, 1 - 1e-12)
            mixed, left = mixed + left * share * above, left * (1 - share)
            yield np.log10(1 - p) @ self.alphabet.zero.T + np.log10(p) @ self.alphabet.one.T, (above, mixed, left)


class Lookup:
    """Rows of contexts by an open table of hashed keys; a key holds its depth."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.keys, self.rows = keys, rows
        self.mask = (1 << max(4, (2 * len(keys)).bit_length())) - 1
        self.table = np.full(self.mask + 1, -1, np.int32)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            empty = self.table[at[left]] < 0
            self.table[at[left[empty]]] = left[empty]
            left = left[self.table[at[left]] != left]
            at[left] = (at[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (stirred(keys) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, at, left = np.full(len(keys), -1, np.int64), self._place(keys), np.arange(len(keys))
        while len(left):
            row = self.table[at[left]]
            left, row = left[row >= 0], row[row >= 0]
            hit = self.keys[row] == keys[left]
            out[left[hit]] = row[hit]
            left = left[~hit]
            at[left] = (at[left] + 1) & self.mask
        return out


def tagged(keys: np.ndarray, depth: int) -> np.ndarray:
    return keys | np.uint64((depth + 1) << 56)


def predicted(lookup: Lookup, cells: np.ndarray) -> np.ndarray:
    """log10 probability of each cell's symbol by its deepest context that has a row."""
    context, symbol = cells >> _8, (cells & np.uint64(255)).astype(np.int64)
    out, left = np.zeros(len(cells)), np.arange(len(cells))
    for d in range(DEPTH, -1, -1):
        row = lookup.find(tagged(context[left] >> np.uint64(8 * (DEPTH - d)), d))
        hit = row >= 0
        out[left[hit]] = lookup.rows[row[hit], symbol[left[hit]]]
        left = left[~hit]
    return out


class _Tally:
    """Counts of integer values over many chunks: sorted values and how often each came."""

    def __init__(self) -> None:
        self.parts, self.size, self.merged = [], 0, 0

    def add(self, values: np.ndarray) -> None:
        self.parts.append(np.unique(values, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > 2 * self.merged + (1 << 20):
            self.values()

    def values(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            both, at = np.unique(np.concatenate([x for x, _ in self.parts]), return_inverse=True)
            self.parts = [(both, np.bincount(at, np.concatenate([n for _, n in self.parts]), len(both)).astype(np.int64))]
        self.size = self.merged = len(self.parts[0][0]) if self.parts else 0
        return self.parts[0] if self.parts else (np.array([], np.int64), np.array([], np.int64))


def _chunks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for x in texts:
        held.append(folded(x))
        size += len(x)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def counted(texts: DataFrame, column: str, values) -> DataFrame:
    """``column, n``: how often each of the integers ``values(folded texts)`` comes over ``texts(text binary)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(tally: _Tally) -> pa.RecordBatch:
            found, n = tally.values()
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=[column, "n"])

        tally = _Tally()
        for some in _chunks(x.as_py() for b in batches for x in b.column(0)):
            tally.add(values(some))
            if tally.size > HELD:
                yield batch(tally)
                tally = _Tally()
        yield batch(tally)

    return texts.mapInArrow(run, f"{column} long, n long").groupBy(column).agg(F.sum("n").alias("n"))


def byte_counts(training: DataFrame) -> np.ndarray:
    """Counts of the 256 bytes, ``END`` once a text."""
    got = counted(training, "byte", lambda texts: np.frombuffer(bytes([END]).join(texts) + bytes([END]), np.uint8).astype(np.int64)).toPandas()  # 256 rows
    total = np.zeros(256)
    total[got["byte"].to_numpy(int)] = got["n"].to_numpy()
    total[END] = max(1, total[END])
    return total


def learn(training: DataFrame, least: int = LEAST) -> tuple[Alphabet, DataFrame, tuple[np.ndarray, np.ndarray]]:
    """Fit on ``training(text binary)``: the alphabet, the model's rows below contexts of ``TOP`` bytes, and those above.

    The first is a table ``near, keys, rows``: the two nearest bytes, tagged contexts and their log10 probabilities
    by symbol in half precision. The driver gets byte counts and a row for each pair of nearest bytes (65,536 at
    most); the rest stays in tables that grow with the text.
    """
    alphabet = Alphabet(byte_counts(training))
    cells = cut(counted(training, "cell", lambda texts: cells_of(texts, alphabet.code)[0]))
    near = cells.withColumn("near", F.shiftrightunsigned("cell", 8 * (DEPTH - TOP + 1)).cast("int"))

    def subtree(rows: pa.Table) -> Subtree:
        cell, n = rows["cell"].to_numpy(), rows["n"].to_numpy()
        order = np.argsort(cell.view(np.uint64))
        return Subtree(cell.view(np.uint64)[order], n[order].astype(float), alphabet, TOP, least)

    def up(rows: pa.Table) -> pa.Table:
        tree = subtree(rows)
        weight = tree.weigh()
        return pa.table({"near": pa.array(tree.keys[0].astype(np.int32)), "counts": [tree.counts[0].tobytes()], "weight": [weight.tobytes()]})

    got = near.groupBy("near").applyInArrow(up, "near int, counts binary, weight binary").toPandas().sort_values("near")
    tops = got["near"].to_numpy(np.int64)
    counts = np.concatenate([np.zeros(0), *(np.frombuffer(x) for x in got["counts"])]).reshape(-1, alphabet.size)
    weight = np.concatenate([np.zeros(0), *(np.frombuffer(x) for x in got["weight"])]).reshape(-1, alphabet.size - 1)
    if not len(tops):  # nothing to learn from: all symbols alike
        return alphabet, cut(near.select("near", F.lit(b"").alias("keys"), F.lit(b"").alias("rows"))), (tagged(np.zeros(1, np.uint64), 0), np.full((1, alphabet.size), -math.log10(alphabet.size), np.float16))
    # The tree above, on the driver: its leaves are the contexts of TOP bytes with their weights from below.
    at, symbol = np.nonzero(counts)
    whole = Subtree((tops[at].astype(np.uint64) << np.uint64(8 * (DEPTH - TOP + 1))) | symbol.astype(np.uint64), counts[at, symbol], alphabet, 0, 1)
    for part in (whole.keys, whole.counts):
        del part[TOP + 1 :]
    del whole.parents[TOP:]
    whole.weigh(weight)
    nodes = alphabet.size - 1
    state, upper = (np.full((1, nodes), 0.5), np.zeros((1, nodes)), np.ones((1, nodes))), []
    for d, (rows, handed) in enumerate(whole.rows(*state)):
        if d < TOP:
            upper.append((tagged(whole.keys[d], d), rows.astype(np.float16)))
            state = handed
    shared = training.sparkSession.sparkContext.broadcast((whole.keys[TOP - 1], state))  # at most 256 rows

    def down(rows: pa.Table) -> pa.Table:
        tree = subtree(rows)
        tree.weigh()
        keys, state = shared.value
        row = np.searchsorted(keys, tree.keys[0] >> _8)
        found = [(tagged(k, TOP + d), r.astype(np.float16)) for d, (k, (r, _)) in enumerate(zip(tree.keys, tree.rows(*(x[row] for x in state)), strict=True))]
        return pa.table({"near": pa.array(tree.keys[0].astype(np.int32)), "keys": [b"".join(k.tobytes() for k, _ in found)], "rows": [b"".join(r.tobytes() for _, r in found)]})

    model = cut(near.groupBy("near").applyInArrow(down, "near int, keys binary, rows binary"))
    free(cells)
    shared.destroy()
    return alphabet, model, (np.concatenate([k for k, _ in upper]), np.concatenate([r for _, r in upper]))


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    """All values of a binary column as one array, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind) if len(column) else np.array([], kind)


def parts(model: DataFrame) -> list[tuple[int, int]]:
    """Ranges of ``near`` (first, last) whose rows take about ``PART`` bytes. Covers every pair of bytes."""
    sizes = model.select("near", (F.length("rows") + F.length("keys")).alias("size")).toPandas().sort_values("near")  # at most 65,536 rows
    part = (sizes["size"].cumsum() - sizes["size"]) // PART
    first = [0, *sizes["near"][part.diff() > 0].tolist()]
    return list(zip(first, [*(x - 1 for x in first[1:]), (1 << 8 * TOP) - 1], strict=True))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


END_WORD = word_hash(b"")


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in turn, and where each text's begin."""
    code, at = word_codes(texts)
    return (code ^ np.uint64(1 << 63)).view(np.int64), at


def score(docs: DataFrame, fold: int = 2, folds: int = 7) -> DataFrame:
    """Score ``docs(doc_id, text)``, learning from those outside the fold.

    Per document: ``held_out, n_tokens, n_known, train_tokens, base_score`` (add-one unigrams), ``score``
    (log10 probability of the folded text and its end) and ``bits_per_byte``, the code length a byte. A null
    or empty text is the end alone (its code length counts as one byte's); a null doc_id is learned from by
    nobody and not held out. Rows that repeat both doc_id and text are one document and give one row. With
    nothing to learn from, all estimates are those of no counts. Texts are scored whole, ``CHUNK`` bytes at
    once, a longer text alone. Words frequent in training are scored in the scan, so that none of them is a
    hot key of the join that scores the others. Words are counted by 64-bit hashes: two of a billion distinct
    words share one with odds of 1 in 37. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), (crc_mod("doc_id", folds) == fold).alias("held_out"))
    training = texts.where(~F.col("held_out") & F.col("doc_id").isNotNull()).select("text")
    counts = cut(counted(training, "word", lambda some: np.append(word_hashes(some)[0], np.full(len(some), END_WORD))))
    train_tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas().sort_values("word")  # FREQUENT rows
    known = spark.sparkContext.broadcast((top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))

    def scan(schema: str, columns) -> DataFrame:
        """``doc_id, text_hash`` and more of every ``CHUNK`` of texts; ``columns()(folded texts, held_out)`` gives the text of each value, or None for one a text, and the values."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
            named, make, rows, size = [x.split() for x in schema.split(", ")], columns(), [], 0

            def emit() -> pa.RecordBatch:
                keys = [pa.array([r[0] for r in rows], pa.int64()), pa.array([word_hash(r[1]) for r in rows], pa.int64())]
                of, values = make([folded(r[1]) for r in rows], [r[2] for r in rows])
                keys = keys if of is None else [x.take(pa.array(of)) for x in keys]
                return pa.RecordBatch.from_arrays([*keys, *(pa.array(x, kinds[k]) for x, (_, k) in zip(values, named[2:], strict=True))], names=[x for x, _ in named])

            for b in batches:
                for row in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                    rows.append((row[0], row[1].as_py(), row[2]))
                    size += len(rows[-1][1])
                    if size >= CHUNK:
                        yield emit()
                        rows, size = [], 0
            if rows:
                yield emit()

        return texts.mapInArrow(run, schema)

    def looked_up(some: list[bytes]) -> tuple[np.ndarray, ...]:
        """The text of each word, words as hashes, their place among the frequent, and who is one."""
        words, starts = word_hashes(some)
        frequent = known.value[0]
        at = np.minimum(np.searchsorted(frequent, words), max(0, len(frequent) - 1))
        return np.repeat(np.arange(len(some)), np.diff(starts)), words, at, frequent[at] == words if len(frequent) else np.zeros(len(words), bool)

    def whole(some: list[bytes], held_out: list) -> tuple:
        owner, _, at, hit = looked_up(some)
        n, (frequent, times) = len(some), known.value
        logs, end = np.log10(times + 1.0), int(np.searchsorted(frequent, END_WORD))
        ended = end < len(frequent) and frequent[end] == END_WORD
        base = np.bincount(owner[hit], logs[at[hit]], n) + (logs[end] if ended else 0.0)
        return None, [held_out, np.ones(n, int), np.bincount(owner, minlength=n) + 1, np.bincount(owner[hit], minlength=n) + ended, base, [max(1, len(x)) for x in some]]

    def others(some: list[bytes], _) -> tuple:
        owner, words, _, hit = looked_up(some)
        order = np.lexsort((words[~hit], owner[~hit]))
        rest, owner = words[~hit][order], owner[~hit][order]
        first = np.nonzero(np.concatenate([[True], (np.diff(rest) != 0) | (np.diff(owner) != 0)])[: len(rest)])[0]
        return owner[first], [rest[first], np.diff(np.append(first, len(rest)))]

    found = scan("doc_id long, text_hash long, word long, times long", lambda: others).join(counts, "word")
    rare = found.groupBy("doc_id", "text_hash").agg(F.sum("times").alias("n_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("base_sum"))
    scanned = scan("doc_id long, text_hash long, held_out boolean, rows long, n_tokens long, n_known long, base_sum double, n_bytes long", lambda: whole)
    sums = cut(scanned.unionByName(rare, allowMissingColumns=True))
    free(counts)
    alphabet, model, upper = learn(training)
    for k, (low, high) in enumerate(parts(model)):
        got = model.where(F.col("near").between(low, high)).select("keys", "rows").toArrow()  # about PART bytes
        arrays = zip(upper, *((_flat(k, np.uint64), _flat(r, np.float16).reshape(-1, alphabet.size)) for k, r in zip(got["keys"].chunks, got["rows"].chunks, strict=True)), strict=True)
        shared = spark.sparkContext.broadcast(tuple(map(np.concatenate, arrays)))
        del got, arrays

        def scorer(low=low, high=high, shared=shared):
            lookup = Lookup(*shared.value)

            def scored(some: list[bytes], _) -> tuple:
                cells, starts = cells_of(some, alphabet.code)
                near = (cells >> np.uint64(8 * (DEPTH - TOP + 1))).astype(np.int64)
                mine, got = np.nonzero((near >= low) & (near <= high))[0], np.zeros(len(cells))
                got[mine] = predicted(lookup, cells[mine])
                total = np.add.reduceat(got, starts[:-1])
                if low == 0:  # what the bytes never seen take of their symbol is counted once
                    raw = np.concatenate([[0.0], np.cumsum(alphabet.rare[np.frombuffer(b"".join(some), np.uint8)])])
                    ends = np.cumsum([0, *map(len, some)])
                    total += raw[ends[1:]] - raw[ends[:-1]]
                return None, [total]

            return scored

        more = cut(scan("doc_id long, text_hash long, score double", scorer))
        sums = sums.unionByName(more, allowMissingColumns=True)
        shared.destroy()
    free(model)
    known.destroy()
    sums = sums.groupBy("doc_id", "text_hash").agg(F.max("held_out").alias("held_out"), *[F.sum(x).alias(x) for x in ("rows", "n_tokens", "n_known", "base_sum", "score", "n_bytes")])
    per = lambda x: F.col(x) / F.col("rows")
    norm = math.log10(train_tokens + distinct + 1)
    return sums.select(
        "doc_id",
        "held_out",
        per("n_tokens").cast("long").alias("n_tokens"),
        per("n_known").cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (per("base_sum") - per("n_tokens") * norm).alias("base_score"),
        per("score").alias("score"),
        (-per("score") * math.log2(10) / per("n_bytes")).alias("bits_per_byte"),
    )


def op5_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
