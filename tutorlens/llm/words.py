"""Words, windows and their hashes for whole Arrow batches, vectorised with numpy.

Everything here runs inside Spark tasks on one Arrow batch at a time. A batch is cut
into segments of a few megabytes, so the working memory does not depend on the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at once; a single longer word stretches its segment.
SEGMENT = 1 << 21
_BASE = U(0x9E3779B97F4A7C15 | 1)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes between terms: all of ASCII but digits and letters.
NOT_TERM = np.ones(256, bool)
NOT_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=U))
_FOLDED = _BYTES.copy()
_FOLDED[0x41:0x5B] = _BYTES[0x61:0x7B]
#: One odd multiplier for each place of a window.
_PLACES = mix(np.arange(1000, 1064, dtype=U)) | U(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, SEGMENT + 65536)
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(n, _BASE), np.full(n, inverse)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows in them; a null row is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(array: pa.Array, fold: bool, gaps: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every row, and where each row's words begin.

    Words are runs of bytes that are not `gaps` (space and the controls 9 to 13); `fold` treats
    A-Z as a-z. Returns (hashes, starts) with len(starts) == rows + 1; a null row has no words.
    """
    data, offsets = utf8(array)
    n = len(data)
    if n == 0:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    gap = gaps[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    first = ~gap
    first[1:] &= gap[:-1] | fresh[1:n]
    last = ~gap
    last[:-1] &= gap[1:] | fresh[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    starts = np.searchsorted(begin, offsets)
    table = _FOLDED if fold else _BYTES
    out = np.empty(len(begin), U)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + SEGMENT, side="right")))
        base = begin[i]
        up, down = _power_tables(int(end[j - 1] - base))
        part = table[data[base : end[j - 1]]]
        part *= up[: len(part)]
        np.cumsum(part, out=part)
        b, e = begin[i:j] - base, end[i:j] - base
        h = part[e - 1]
        h[b > 0] -= part[b[b > 0] - 1]
        h *= down[b]
        out[i:j] = mix(h + (e - b).astype(U) * U(0xD6E8FEB86659FD93))
        i = j
    return out, starts


def windows(hashes: np.ndarray, starts: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of `width` words that lies in one row, and the index of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.full(n, U(seed * 2 + width), U)
    for k in range(width):
        h += hashes[k : k + n] * _PLACES[(k + seed * 31) % len(_PLACES)]
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    return mix(h[at]), at


def shingle_sets(array: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles, A-Z taken as a-z.

    A row with some words, but fewer than `width`, has one shingle of all of them.
    """
    hashes, starts = words(array, fold=True)
    h, at = windows(hashes, starts, width)
    cut = np.searchsorted(at, starts)
    for i in range(len(starts) - 1):
        if cut[i + 1] > cut[i]:
            yield np.unique(h[cut[i] : cut[i + 1]])
        elif starts[i + 1] > starts[i]:
            few = hashes[starts[i] : starts[i + 1]]
            yield windows(few, np.array([0, len(few)]), len(few))[0]
        else:
            yield np.zeros(0, U)


def slices(batch: pa.RecordBatch, text: str, most: int = 4 * SEGMENT) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of the text column, so that memory stays bounded."""
    _, offsets = utf8(batch.column(text)) if batch.num_rows else (None, np.zeros(1, np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
