"""Words of many texts as hashes in one array, and hashes of runs of words."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer text alone.
CHUNK = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts in turn, and where each text's words begin; one bound more than texts."""
    from xxhash import xxh3_64_intdigest

    words = [t.split() for t in texts]
    at = np.cumsum([0, *map(len, words)])
    return np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(at[-1])), at


def run_codes(code: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words, those over the end of a text included."""
    m = max(0, len(code) - n + 1)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out *= _ODD
        out += code[i : m + i]
    return stirred(out)


def range_codes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words of each range: a polynomial's prefix sums, brought to one power."""
    powers, back = (np.concatenate([[np.uint64(1)], np.full(len(code), x, np.uint64)]).cumprod(dtype=np.uint64) for x in (_ODD, _BACK))
    sums = np.concatenate([[np.uint64(0)], (code * powers[:-1]).cumsum(dtype=np.uint64)])
    return stirred((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def chunks(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about ``CHUNK`` bytes in their binary column ``text``, and its texts (null: empty)."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + CHUNK, side="right")))
            part = b.slice(at, to - at)
            yield part, [x.as_py() or b"" for x in part.column(text)]
            at = to
