"""Vectorised word and shingle hashes over Arrow text columns.

Words are maximal runs of bytes other than the six ASCII white-space characters (0x20 and
0x09-0x0D), with A-Z lowered.  A text is hashed whole; texts are taken in blocks of about a
megabyte so that temporary arrays stay small whatever the Arrow batch holds.

The distinct words of a block are told apart by their bytes, and each is hashed by XXH3, whose collisions
do not follow from the words' form: two different words, or two different shingles, share a hash by
chance alone, once in 2**64 pairs.  (A polynomial modulo 2**64 would not do: Thue-Morse words collide
under every base.)  ``span_hashes`` is such a polynomial; it only serves to find borders, and over hashes of words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 20
SEED = 20240229

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers modulo 2**64, for exponents below ``n`` at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + (1 << 16))
        steps = [np.full(size, base, U64) for base in (BASE, pow(BASE, -1, 1 << 64))]
        for x in steps:
            x[0] = 1
        _powers[:] = map(np.multiply.accumulate, steps)
    return _powers[0], _powers[1]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span of bytes or word hashes, not mixed."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[end] - total[start]) * down[start]


def release() -> None:
    """Give freed memory back to the system: a Python worker is kept for later tasks, with all it has ever freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the C library of GNU
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64's finaliser)."""
    x = np.bitwise_xor(x, x >> U64(30)) * U64(0xBF58476D1CE4E5B9)
    x = np.bitwise_xor(x, x >> U64(27)) * U64(0x94D049BB133111EB)
    return np.bitwise_xor(x, x >> U64(31))


def text_blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, row after the last, bytes, offsets) of about ``limit`` bytes; null is empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def distinct(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The stretches between ``bounds``, which cover ``raw``: the number of each among the distinct ones, and those."""
    if len(bounds) < 2:
        return np.zeros(0, np.int32), []
    every = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = every.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each text the index of its first word (with the end at last)."""
    if not len(raw):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    low = LOWER[raw]
    full = ~SPACE[raw]
    first = full.copy()
    first[1:] &= ~full[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = full[heads]
    last = full.copy()
    last[:-1] &= ~full[1:]
    last[heads[1:] - 1] = full[heads[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    which, every = distinct(low[full], np.concatenate([[0], np.cumsum(end - start)]))
    return np.array([xxhash.xxh3_64_intdigest(w, SEED) for w in every], U64)[which], np.searchsorted(start, offsets)


def shingles(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words within a text, and where each text's runs begin (with the end).

    A text of fewer words has its whole sequence as one run; a text without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(begin[-1], U64)
    factor = [pow(0xA0761D6478BD642F | 1, i + 1, 1 << 64) for i in range(k)]
    if len(word) >= k:
        h = np.zeros(len(word) - k + 1, U64)
        for i, f in enumerate(factor):
            h += word[i : i + len(h)] * U64(f)
        long = np.flatnonzero(n >= k)
        at = np.repeat(first[:-1][long] - begin[:-1][long], count[long])
        to = np.flatnonzero(np.repeat(n >= k, count))
        out[to] = h[to + at] + U64(k)
    for d in np.flatnonzero((n > 0) & (n < k)):
        h = int(n[d])
        for i in range(int(n[d])):
            h = (h + int(word[first[d] + i]) * factor[i]) & MASK
        out[begin[d]] = h
    return mix(out), begin
