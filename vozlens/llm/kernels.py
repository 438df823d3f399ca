"""Vectorised text kernels over Arrow buffers: words, word hashes, shingles, set sketches.

All work on the UTF-8 bytes of whole texts.  ASCII letters are lower-cased and
words are runs of bytes outside ``\\x20\\x09-\\x0D``, which in UTF-8 is the same
as the code-point class ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; made anew for each slice, so that no worker keeps the longest one's."""
    up = np.full(n, BASE, dtype=U64)
    down = np.full(n, pow(BASE, -1, 1 << 64), dtype=U64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, out=up), np.cumprod(down, out=down)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(ends) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_table() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[32, 9, 10, 11, 12, 13]] = True
    return t


def words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word (n + 1 values)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    ink = ~space_table()[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[ends] = True  # texts lie end to end: their borders also part words
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:n]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:n]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(start, ends)


def hash_ranges(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: polynomial by prefix sums modulo 2**64, then mixed."""
    up, down = powers(len(raw) + 1)
    up = up[:-1]
    up *= raw.astype(U64) + U64(1)
    sums = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(up, out=sums[1:])
    poly = (sums[stop] - sums[start]) * down[start]
    return mix(poly + mix((stop - start).astype(U64) * U64(GOLDEN)))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word of every text, and the n + 1 offsets by text."""
    raw, ends = utf8(column)
    start, stop, by = words(raw, ends)
    if not len(start):
        return np.zeros(0, U64), by
    return hash_ranges(lower_table()[raw], start, stop), by


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    Fewer than k words: the whole sequence is the one shingle. No words or null: empty.
    """
    w, by = word_hashes(column)
    mult = U64(0xD6E8FEB86659FD93)
    rolled = w.copy()
    for j in range(1, k):
        rolled = rolled[:-1] * mult + w[j:] if len(w) > j else rolled[:0]
    rolled = mix(rolled)
    out = []
    for a, b in zip(by[:-1].tolist(), by[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            acc = w[a : a + 1].copy()
            for j in range(a + 1, b):
                acc = acc * mult + w[j : j + 1]
            out.append(mix(acc + U64(b - a)))  # apart from shingles of k words
        else:
            out.append(np.zeros(0, U64))
    return out
