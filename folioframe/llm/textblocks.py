"""Words of whole texts, straight from Arrow buffers.

A word is ``[^\\x20\\x09-\\x0D]+``. As the separators are ASCII, splitting the UTF-8
bytes gives the same words as splitting code points, so whole Arrow batches are
tokenised with numpy and no Python string is made. Each word gets a 64-bit
polynomial hash, finished with a mixing step; sequences of words are hashed by a
polynomial over word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD1342543DE82EF95)
_SPAN = 1 << 20
MOST_DOCUMENTS = 50_000  # in a chunk, so that 16 bits number them


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``base`` and of its inverse, modulo 2^64."""
    key = int(base)
    if key not in _cache or len(_cache[key][0]) < n:
        _cache[key] = _powers(base, max(n, _SPAN + 1))
    up, down = _cache[key]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all bits of uint64 values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """Words of the documents ``lo`` to ``hi`` of a batch.

    ``offsets[i]`` to ``offsets[i + 1]`` are the words of document ``lo + i``;
    ``starts`` and ``ends`` are byte positions in ``data``.
    """

    lo: int
    hi: int
    data: np.ndarray
    doc_bytes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray | None = None

    def document(self, i: int) -> bytes:
        return self.data[self.doc_bytes[i] : self.doc_bytes[i + 1]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and row offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_ranges(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes, one document at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1), lo + MOST_DOCUMENTS)
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, computed over spans of about a megabyte."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + _SPAN, side="right"))
        j = max(j, i + 1)
        begin, stop = int(starts[i]), int(ends[j - 1])
        up, down = powers(_BASE, stop - begin + 1)
        sums = np.empty(stop - begin + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data[begin:stop].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        s, e = starts[i:j] - begin, ends[i:j] - begin
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out)


def chunks(column: pa.Array, limit: int = 4 << 20, lower: bool = False, hashes: bool = True) -> Iterator[Words]:
    """The words of a text column, a few megabytes of whole documents at a time."""
    data, offsets = buffers(column)
    for lo, hi in doc_ranges(offsets, limit):
        part = data[offsets[lo] : offsets[hi]]
        if lower:
            part = LOWER[part]
        bounds = offsets[lo : hi + 1] - offsets[lo]
        inside = ~SEPARATORS[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = bounds[:-1] < bounds[1:]
        first[bounds[:-1][full]] = inside[bounds[:-1][full]]
        last[bounds[1:][full] - 1] = inside[bounds[1:][full] - 1]
        starts = np.flatnonzero(first)
        ends = np.flatnonzero(last) + 1
        words = Words(lo, hi, part, bounds, starts, ends, np.searchsorted(starts, bounds))
        if hashes:
            words.hashes = word_hashes(part, starts, ends)
        yield words


def sequence_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words, across document ends too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _WORD_BASE + hashes[j : j + n]
    return mix(out + np.uint64(k))


def prefix_sums(hashes: np.ndarray, base: np.uint64 = _WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for span hashes: ``(sums[e] - sums[s]) * down[s]`` hashes words s to e."""
    up, down = powers(base, len(hashes) + 1)
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return sums, down


def as_long(x: np.ndarray) -> pa.Array:
    """uint64 values as the signed longs of Spark, bit for bit."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
