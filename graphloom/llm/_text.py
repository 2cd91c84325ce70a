"""Vectorised tokenisation and fingerprints over Arrow string columns (numpy only).

A *word* is a maximal run of bytes outside {0x20, 0x09-0x0D}.  Every function
works on one flat byte buffer plus document offsets, so the cost is a few numpy
passes over the bytes and never a Python call per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_PIECE = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20240611))
_TABLE = _rng.integers(0, 2**64, 256, dtype=U64) | U64(1)
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_Q1, _Q2 = U64(0xD1342543DE82EF95), U64(0xA0761D6478BD642F)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that every output bit depends on all input bits."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each document (plus the total)."""
    space = IS_SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    before = np.ones(len(buf), bool)
    before[1:] = space[:-1]
    before |= cut[:-1]
    starts = np.flatnonzero(before & ~space)
    after = np.ones(len(buf), bool)
    after[:-1] = space[1:]
    after |= cut[1:]
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class _Powers:
    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * _PIECE)
            cls.up, cls.down = (np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, p, U64), dtype=U64)]) for p in (_P, _P_INV))
        return cls.up, cls.down


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word: a prefix sum of table[byte] * P^i, shifted back by the inverse power."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + _PIECE, "right")))
        piece = buf[base : ends[upto - 1]]
        up, down = _Powers.of(len(piece))
        sums = np.zeros(len(piece) + 1, U64)
        np.cumsum(_TABLE[LOWER[piece] if lower else piece] * up[: len(piece)], out=sums[1:])
        s, e = starts[at:upto] - base, ends[at:upto] - base
        out[at:upto] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * _Q2)
        at = upto
    return out


def windows(words: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hash of each run of k consecutive values (len(words) - k + 1 of them); second: an independent one."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    q, out = (_Q2 if second else _Q1), np.zeros(n, U64)
    for j in range(k):
        out *= q
        out += words[j : j + n]
    return mix(out)


def inside(first: np.ndarray, n_windows: int, k: int) -> np.ndarray:
    """Which windows of k lie within one document. first: index of each document's first word, and the total."""
    ok = np.ones(max(n_windows, 0), bool)
    for d in range(1, k):
        at = first[1:-1] - d
        ok[at[(at >= 0) & (at < n_windows)]] = False
    return ok


def owner(first: np.ndarray) -> np.ndarray:
    """The document index of each word."""
    return np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
