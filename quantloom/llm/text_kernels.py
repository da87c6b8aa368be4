"""Vectorized text helpers for Arrow batches: word bounds, word hashes and shingles over the raw UTF-8 bytes.

Everything works on slices of about a megabyte, so memory does not depend on the batch size; a longer text is a
slice of its own. Hashes are 64-bit: equal words have equal hashes; unequal ones collide by chance only, of about 2^-64.
Sums of powers modulo 2^64 have known collisions among words of about a thousand bytes, so words of LONG bytes and more
have a BLAKE2 hash instead.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
LONG = 128
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
#: Lower-cases the ASCII letters of a byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTES = _BYTES[LOWER]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Byte classes: not ASCII white space; and letters, digits and everything beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[lo:hi] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    if n > SLICE_BYTES * 2:  # don't keep tables for a rare long text
        out = _POWERS[0], _POWERS[1]
        _POWERS[0], _POWERS[1] = out[0][: SLICE_BYTES * 2].copy(), out[1][: SLICE_BYTES * 2].copy()
        return out
    return _POWERS[0], _POWERS[1]


def released() -> None:
    """Give memory that a task has freed back to the machine; a worker that Spark keeps would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of pieces of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(raw: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of a byte class, and the index of each text's first run (and the end)."""
    inside = kind[raw]
    first, last = inside.copy(), inside.copy()
    if len(raw):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = off[:-1] < off[1:]
        heads, tails = off[:-1][full], off[1:][full] - 1
        first[heads] = inside[heads]
        last[tails] = inside[tails]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes, ASCII letters in lower case."""
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h = mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(end - start >= LONG):
        h[i] = int.from_bytes(hashlib.blake2b(LOWER[raw[start[i] : end[i]]].tobytes(), digest_size=8).digest(), "little")
    return h


def hash_of(word: str) -> int:
    """The hash that word_hashes() gives one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


_PLACES = mix(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct k-word shingles of each text, sorted by both as unsigned numbers.

    A text with 1 to k-1 words has one shingle, all its words; one without words has none.
    """
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    out_text, out_hash = [], []
    if len(hashes) >= k:
        m = len(hashes) - k + 1
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h += hashes[j : j + m] * _PLACES[j]
        whole = text[:m] == text[k - 1 :]
        out_text.append(text[:m][whole])
        out_hash.append(mix(h[whole] + np.uint64(k)))
    for size in range(1, k):
        t = np.flatnonzero(n == size)
        if len(t):
            h = np.zeros(len(t), np.uint64)
            for j in range(size):
                h += hashes[bounds[t] + j] * _PLACES[j]
            out_text.append(t)
            out_hash.append(mix(h + np.uint64(size)))
    if not out_text:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    t, h = np.concatenate(out_text), np.concatenate(out_hash)
    order = np.lexsort((h, t))
    t, h = t[order], h[order]
    keep = np.ones(len(t), bool)
    keep[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    return t[keep], h[keep]


def shingle_slices(column: pa.Array, k: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, text index in the slice, shingle) for each slice of a string column."""
    for lo, hi, raw, off in slices(column):
        start, end, bounds = words(raw, off, NOT_SPACE)
        yield lo, hi, *shingles(word_hashes(raw, start, end), bounds, k)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each row's list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
