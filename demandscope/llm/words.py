"""Words of Arrow string columns as positions and 64-bit hashes, without a Python step per word.

A word is a stretch of bytes other than the space and 0x09-0x0D, so UTF-8 needs no decoding. The hash is a polynomial
of the word's bytes modulo 2**64, mixed with the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = [np.ones(1, dtype=np.uint64)]


class Words(NamedTuple):
    doc: np.ndarray  # row of the column
    start: np.ndarray  # place in ``data``
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray  # the column's bytes
    offsets: np.ndarray  # of the rows in ``data``


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(*parts: np.ndarray) -> np.ndarray:
    """Hash of a tuple of hashes, in order."""
    out = mix(parts[0])
    for p in parts[1:]:
        out = mix(out * _BASE + p)
    return out


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its rows' offsets in them; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if places is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the base."""
    if _POWERS[0].size < n:
        size = max(n, 1024)
        grown = np.full(size, _BASE, dtype=np.uint64)
        grown[0] = 1
        _POWERS[0] = np.multiply.accumulate(grown)
    return _POWERS[0][:n]


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for spans that are not empty, ascending and do not overlap."""
    if not start.size:
        return np.zeros(0, np.uint64)
    length = end - start
    total = int(length.sum())
    first = np.cumsum(length) - length
    inside = np.arange(total) - np.repeat(first, length)
    value = data[inside + np.repeat(start, length)].astype(np.uint64) + np.uint64(1)
    value *= powers(int(length.max()))[inside]
    return mix(np.add.reduceat(value, first) ^ (length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words(column: pa.Array) -> Words:
    data, offsets = raw_bytes(column)
    n = data.size
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), data, offsets)
    letter = ~_SEPARATOR[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    begins[edges] = letter[edges]  # a row's first byte begins a word even where the row before ends in one
    ends = letter.copy()
    ends[:-1] &= ~letter[1:]
    ends[edges - 1] = letter[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(start.size, np.uint64)
    at = 0
    while at < start.size:  # in blocks, so that what is held per byte stays small
        to = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK_BYTES, side="right")))
        hashes[at:to] = spans_hash(data, start[at:to], end[at:to])
        at = to
    return Words(np.searchsorted(offsets, start, side="right") - 1, start, end, hashes, data, offsets)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of ``k`` words of one row."""
    m = w.hash.size - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(w.doc[:m] == w.doc[k - 1:])
    return first, combine(*(w.hash[first + i] for i in range(k)))


def slices(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``limit`` bytes of text, so that what is held per byte stays small."""
    _, offsets = raw_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
