"""Periodic runs of words: every maximal stretch that repeats with some smallest period.

Periods below ``SHORT`` are found by comparing a text with itself at each lag. Longer ones are looked for scale by scale,
periods from Q to 2Q at once: a gram of Q/4 words has a hash, a window of Q/4 grams its least one, and inside of a run
the same window, hence the same minimizer, recurs a period later. Pairs of equal minimizers at a distance of Q to 2Q are seeds,
which hashes of prefixes extend to both sides; the words decide in the end. Grams that are themselves periodic (period
up to a quarter of the gram) rank behind all others and seed nothing: equal grams that are left lie apart, so that
there are few pairs. What lies in these only repeats where two runs of one short period meet, and there the periods form a progression
that is tried as a whole.

The texts of a batch are joined, a word that occurs nowhere else after each, so all are searched by the same whole-array steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm._util import table
from tellurion.llm._words import chunks, stirred

#: Least length of a run in words, and of what is noted on the way.
LEAST, NOTED = 12, 8
#: Periods below it are found by lag.
SHORT = 32
U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
SPACE = r"[\x20\x09-\x0D]+"


class _Ids(dict):
    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        return n


def stretches(w: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal stretch of period ``q`` (words ``q`` apart equal), at least ``max(NOTED, 2q)`` long."""
    same = np.concatenate([[False], w[q:] == w[:-q], [False]])
    at = np.flatnonzero(same[1:] != same[:-1])
    start, end = at[::2], at[1::2] + q
    long = end - start >= max(NOTED, 2 * q)
    return start[long], end[long]


class _Runs:
    """Runs found so far, shortest periods first."""

    def __init__(self, n: int):
        self.n, self.start, self.end, self.period = n, *(np.empty(0, np.int64) for _ in range(3))

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """Add stretches but those of a period that isn't the smallest: a run with less has the same ends."""
        order = np.lexsort((period, end, start))
        key = (start * (self.n + 1) + end)[order]
        first = order[np.diff(key, prepend=-1) != 0]
        first = first[~np.isin(start[first] * (self.n + 1) + end[first], self.start * (self.n + 1) + self.end)]
        self.start, self.end, self.period = (np.concatenate([a, b[first]]) for a, b in ((self.start, start), (self.end, end), (self.period, period)))


class _Prefixes:
    """Hashes of ranges of words by polynomial prefix sums."""

    def __init__(self, code: np.ndarray):
        self.power = np.concatenate([[U(1)], np.full(len(code), _ODD, U)]).cumprod(dtype=U)
        self.sums = np.concatenate([[U(0)], (code * self.power[:-1]).cumsum(dtype=U)])

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ranges from ``a`` and from ``b`` > ``a`` look equal."""
        of = lambda x: self.sums[x + length] - self.sums[x]
        return of(a) * self.power[b - a] == of(b)

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How far the words from ``a`` on (or before it) equal those from ``b`` on, up to ``most``."""
        low, high = np.zeros(len(a), np.int64), most.copy()  # equal up to low, not beyond high
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_] + 1) // 2
            shift = mid if back else 0
            ok = self.same(a[open_] - shift, b[open_] - shift, mid)
            low[open_[ok]], high[open_[~ok]] = mid[ok], mid[~ok] - 1
        return low


def _extended(w: np.ndarray, prefix: _Prefixes, at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of period ``q`` that hold the words ``at`` and ``at + q``, at least ``2q`` long."""
    n, half = len(w), (q + 1) // 2
    fits = at + q + half <= n
    ahead = np.zeros(len(at), bool)
    ahead[fits] = prefix.same(at[fits], (at + q)[fits], half[fits])
    behind = ~ahead & (at >= half)
    behind[behind] = prefix.same((at - half)[behind], (at - half + q)[behind], half[behind])
    at, q = at[ahead | behind], q[ahead | behind]
    if not len(at):
        return at, at, q
    right = prefix.reach(at, at + q, n - at - q, False)
    left = prefix.reach(at, at + q, at, True)
    start, end = at - left, at + q + right
    long = end - start >= 2 * q
    found = np.unique(np.stack([start[long], end[long], q[long]]), axis=1)
    out = []
    for s, e, p in found.T.tolist():
        sure = np.array_equal(w[s : e - p], w[s + p : e]) and (s == 0 or w[s - 1] != w[s + p - 1]) and (e == n or w[e] != w[e - p])
        if sure:
            out.append((s, e, p))
        else:  # two ranges had one hash: all stretches of this period, word by word
            out += [(a, b, p) for a, b in zip(*map(np.ndarray.tolist, stretches(w, p)), strict=True)]
    return tuple(np.array(c, np.int64) for c in (zip(*out, strict=True) if out else ([], [], [])))


def _progressions(w: np.ndarray, runs: _Runs, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of periods from ``q`` to ``2q`` where two runs of one period, at most ``q / 16``, meet: places and periods."""
    p = runs.period
    some = np.flatnonzero((p <= q // 16) & (runs.end - runs.start >= q))
    some = some[np.lexsort((runs.start[some], p[some]))]
    a, b = some[:-1], some[1:]
    near = (p[a] == p[b]) & (runs.start[b] <= runs.end[a]) & (runs.start[b] > runs.end[a] - 2 * p[a])
    at, period = [], []
    for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
        p, b0 = int(runs.period[x]), int(runs.start[y])
        e0 = int(runs.end[x])
        unit = w[b0 : b0 + p]
        for d in range(p):  # the phase at which the first run shows the second one's unit
            z = e0 - p - d
            if z >= runs.start[x] and np.array_equal(w[z : z + p], unit):
                most = min(2 * q - 1, b0 + p - 1 - int(runs.start[x]))
                ks = np.arange(max(0, -(-(q - (b0 - z)) // p)), (most - (b0 - z)) // p + 1)
                at.append(z + p - 1 - ks * p)
                period.append(b0 - z + ks * p)
                break
    return (np.concatenate(at), np.concatenate(period)) if at else (np.empty(0, np.int64),) * 2


def _seeds(w: np.ndarray, hashes: np.ndarray, pos: np.ndarray, runs: _Runs, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal minimizers ``q`` to ``2q`` apart: places and distances. ``hashes`` are those of the grams at ``pos``."""
    g = window = q // 4
    size = int(len(w)).bit_length()
    flat = np.zeros(len(w) + 1, np.int32)
    known = (runs.period <= g // 4) & (runs.end - runs.start >= g)
    np.add.at(flat, runs.start[known], 1)
    np.add.at(flat, runs.end[known] - g + 1, -1)
    dull = (np.cumsum(flat[:-1]) > 0)[pos]
    # The least of a window: grams that don't repeat in themselves first, then the hash, then the place.
    rank = (hashes >> U(size + 1) << U(size)) | np.arange(len(pos), dtype=U) | (dull.astype(U) << U(63))
    step = 1
    while step < window:
        move = min(step, window - step)
        rank = np.minimum(rank[:-move], rank[move:]) if move < len(rank) else rank[:1]
        step += move
    keep = np.concatenate([[True], rank[1:] != rank[:-1]]) & (rank >> U(63) == 0)
    index = np.unique((rank[keep] & U((1 << size) - 1)).astype(np.int64))
    place, value = pos[index], hashes[index]
    order = np.lexsort((place, value))
    place, value = place[order], value[order]
    at, lag = [], []
    for k in range(1, len(place)):
        apart = place[k:] - place[:-k]
        near = (value[k:] == value[:-k]) & (apart < 2 * q)
        if not near.any():
            break
        hit = near & (apart >= q)
        at.append(place[:-k][hit])
        lag.append(apart[hit])
    return (np.concatenate(at), np.concatenate(lag)) if at else (np.empty(0, np.int64),) * 2


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words its runs of at least ``LEAST`` words: rows of start, length and smallest period, by start and period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    n = int(begin[-1])
    ids, w = _Ids(), np.empty(n, np.int64)
    for k, t in enumerate(texts):
        w[begin[k] : begin[k + 1] - 1] = np.fromiter(map(ids.__getitem__, t), np.int64, len(t))
        w[begin[k + 1] - 1] = -1 - k
    runs = _Runs(n)
    for q in range(1, min(SHORT, n)):
        start, end = stretches(w, q)
        if len(start):
            runs.add(start, end, np.full(len(start), q, np.int64))
    most = int(lengths.max(initial=0))
    if most >= 2 * SHORT:
        code = stirred(w.view(U) + _ODD)
        prefix, hashes, gram, pos = _Prefixes(code), code, 1, np.arange(n)
        q, live = SHORT, lengths
        while most >= 2 * q:
            keep = np.repeat(live >= 2 * q, live + 1)  # texts long enough for the scale
            hashes, pos, live = hashes[keep], pos[keep], live[live >= 2 * q]
            while gram < q // 4:  # a gram's hash from those of its halves
                hashes = stirred(hashes * _ODD + np.concatenate([hashes[gram:], np.zeros(min(gram, len(hashes)), U)]))
                gram *= 2
            tried = [_seeds(w, hashes, pos, runs, q), _progressions(w, runs, q)]
            seeds = np.unique(np.stack([np.concatenate(c) for c in zip(*tried, strict=True)]), axis=1)
            runs.add(*_extended(w, prefix, *seeds))
            q *= 2
    some = runs.end - runs.start >= LEAST
    start, end, period = runs.start[some], runs.end[some], runs.period[some]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    cuts = np.searchsorted(start, begin)
    return [np.stack([start[a:b] - o, (end - start)[a:b], period[a:b]], axis=1) for a, b, o in zip(cuts, cuts[1:], begin, strict=False)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if len(runs):
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
        np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
    return b" ".join(words)


SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, collapsed_text`` of every row of ``docs(doc_id, text)``.

    ``runs`` has each run of at least ``LEAST`` words and twice its smallest period that no neighbouring word extends,
    as ``start`` (word number from 0), ``length`` and ``period``, by start and period. ``collapsed_text`` is the text without the
    words that a run holds after its first period, its words joined by one space.

    Nothing is shuffled. Null and wordless text has no run and an empty text; a null ``doc_id`` stays null; rows that
    repeat are rows of their own; an empty table gives no rows; other columns are not read. A text of any length is
    searched whole, in memory for its own words.
    """
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = [t.split() for t in texts]
            found = runs_of(words)
            whole = np.concatenate(found)
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(whole[:, k]) for k in range(3)], fields=list(kind)))
            text = pa.array([collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), runs, text], names=["doc_id", "runs", "collapsed_text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; where crc32(doc_id) % 10 is 0, the text's words from the a-th on repeat the p words from there."""
    h, words = F.crc32(F.col("doc_id").cast("string")), F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda x: x != "")
    some = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).cast("long").alias("g"))
    n = F.size("w")
    a = F.col("a")
    some = some.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int")).withColumn("p", (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int"))
    unit = F.slice("w", a + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / F.col("p")).cast("int"))), F.lit(1), n - a)
    return some.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("brief"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    top = found.withColumn("top", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.back")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.brief")).alias("period"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
    return top.withColumn("exponent_milli", F.expr("1000 * length div period"))
