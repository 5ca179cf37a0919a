"""Static binary-fuse filters of 64-bit codes (Graf and Lemire, 2022), built and asked in whole arrays.

A code has three cells in neighbouring segments; their bytes' exclusive or is the code's fingerprint. Cells are given
by peeling: in rounds, every cell that only one code is left in is that code's own, and the code goes.
"""

from __future__ import annotations

import math

import numpy as np

from tellurion.llm._words import stirred

#: Seeds that are tried; one fails about once in a hundred.
SEEDS = 64
U = np.uint64


def shape(n: int) -> tuple[int, int]:
    """Cells a segment (a power of two), and segments, for ``n`` codes."""
    if n < 2:
        return 4, 3
    segment = 1 << max(2, min(18, math.floor(math.log(n) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    return segment, max(3, -(-round(n * factor) // segment))


def places(codes: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three cells of each code, a row each, and its fingerprint."""
    h = stirred(codes + U(seed) * U(0x9E3779B97F4A7C15))
    first = ((h >> U(32)) * U((segments - 2) * segment)) >> U(32)
    mask = U(segment - 1)
    at = np.stack([first, (first + U(segment)) ^ ((h >> U(18)) & mask), (first + U(2 * segment)) ^ (h & mask)])
    return at.astype(np.int64), (stirred(h) & U(255)).astype(np.uint8)


def peeled(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of codes and their own cells, or None where some codes can't be parted."""
    n = at.shape[1]
    left, owner = np.bincount(at.ravel(), minlength=size), np.zeros(size, np.int64)
    for row in at:
        np.bitwise_xor.at(owner, row, np.arange(n))
    rounds, done, lone = [], 0, np.nonzero(left == 1)[0]
    while len(lone):
        who, first = np.unique(owner[lone], return_index=True)
        rounds.append((who, lone[first]))
        done += len(who)
        touched = at[:, who].ravel()
        np.subtract.at(left, touched, 1)
        np.bitwise_xor.at(owner, touched, np.tile(who, 3))
        lone = np.unique(touched)
        lone = lone[left[lone] == 1]
    return rounds if done == n else None


def build(codes: np.ndarray) -> tuple[int, int, bytes]:
    """Seed, cells a segment and the cells' bytes of a filter that holds all ``codes`` (repeats count once)."""
    codes = np.unique(codes.astype(np.uint64))
    segment, segments = shape(len(codes))
    for seed in range(SEEDS):
        at, mark = places(codes, seed, segment, segments)
        rounds = peeled(at, segment * segments)
        if rounds is not None:
            cells = np.zeros(segment * segments, np.uint8)
            for who, own in reversed(rounds):
                cells[own] = mark[who] ^ np.bitwise_xor.reduce(cells[at[:, who]], axis=0)
            return seed, segment, cells.tobytes()
    raise RuntimeError(f"no seed parts {len(codes)} codes")


def held(codes: np.ndarray, seed: int, segment: int, cells: bytes) -> np.ndarray:
    """Whether the filter may hold each code: always where it does, else once in 256."""
    table = np.frombuffer(cells, np.uint8)
    at, mark = places(codes.astype(np.uint64), seed, segment, len(table) // segment)
    return np.bitwise_xor.reduce(table[at], axis=0) == mark
