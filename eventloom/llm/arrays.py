"""Arrow batches of texts as numpy arrays: words, shingles and their hashes, a few MB at a time."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of MurmurHash3)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the rows' offsets in them; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    at = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = constants(256, 11)[_LOWER]
_BYTE_AS_IS = constants(256, 11)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of anything but ASCII white space, A-Z lower-cased, and where each row's begin."""
    n = len(offsets) - 1
    inside = ~_SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[-1] = True
    edge[:-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1] & inside)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    word_bytes = np.flatnonzero(inside)
    begin = np.searchsorted(word_bytes, starts)
    place = np.arange(len(word_bytes)) - np.repeat(begin, np.diff(np.append(begin, len(word_bytes))))
    weight = constants(int(place.max()) + 1, 77)
    h = np.add.reduceat((_BYTE if lower else _BYTE_AS_IS)[data[word_bytes]] * weight[place], begin)
    return mix(h), np.searchsorted(starts, offsets)


def shingles(w: np.ndarray, first: np.ndarray, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` words in a row within each row, and where each row's begin. ``whole``: fewer words make one shingle."""
    c = constants(k + 1, 5)
    count = np.diff(first)
    n = np.maximum(count - k + 1, 0)
    if whole:
        n = np.where((count > 0) & (count < k), 1, n)
    begin = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
    h = np.zeros(len(at), U64)
    end = np.repeat(first[1:], n)
    padded = np.append(w, np.zeros(k, U64))
    for j in range(k):
        h += np.where(at + j < end, padded[at + j] * c[j], c[k:] * U64(j + 1))
    return mix(h), begin
