"""Vectorised helpers over Arrow text columns: bytes, words, hashes, bounded slices.

A text column is treated as one byte buffer with row offsets, so a batch of
documents costs a fixed number of numpy passes whatever their lengths are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled by one set of numpy arrays (a single longer row is taken alone).
CHUNK_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def one_chunk(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` text bytes (one row at least); the column is the text or its size."""
    n = batch.num_rows
    if not n:
        return
    sizes = batch.column(column)
    sizes = sizes if pa.types.is_integer(sizes.type) else pc.binary_length(sizes)
    ends = np.cumsum(np.asarray(pc.fill_null(sizes, 0)).astype(np.int64))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row offsets (n + 1); a null is empty."""
    array = pc.fill_null(one_chunk(array), "" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


@lru_cache
def space_table() -> np.ndarray:
    """True for a word byte: everything but 0x20 and 0x09-0x0D."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


@lru_cache
def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of ``inside`` within a row."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache
def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * ODD)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), ODD, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def segment_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run [start, end); runs ascend and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(first, length)
    values = byte_codes()[raw[at + np.repeat(starts, length)]] * powers(int(length.max()))[at]
    out = np.zeros(len(starts), np.uint64)
    full = length > 0
    out[full] = np.add.reduceat(values, first[full])
    return mix(out + length.astype(np.uint64) * MIX1)


def row_counts(rows: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(rows, weights, minlength=n).astype(np.int64)


def window_hash(values: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive values of one row, and the index of each window's first value."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * ODD + values[k : k + n]
    first = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return mix(total[first]), first


def unique_per_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, ascending by row, then value."""
    if not len(values):
        return values, rows
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    keep = np.concatenate(([True], (v[1:] != v[:-1]) | (r[1:] != r[:-1])))
    return v[keep], r[keep]
