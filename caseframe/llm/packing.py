"""Integer columns as compressed byte planes: few bytes an entry where rows of numbers would cost twenty."""

from __future__ import annotations

import numpy as np
import zstandard

#: Hashes keep so many bits where a clash costs work, not results.
TOKEN_BITS = 48


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length; the first ascends and is stored as differences."""
    planes = []
    for k, column in enumerate(columns):
        values = np.ascontiguousarray(column, np.uint64)
        if k == 0 and len(values):
            values = np.diff(values, prepend=np.uint64(0))
        planes.append(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    planes = raw.reshape(columns, 8, -1)
    out = [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def by_bucket(bucket: np.ndarray, n: int):
    """(bucket, slice) of each run in an ascending array of bucket numbers below ``n``."""
    edges = np.searchsorted(bucket, np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), slice(int(edges[b]), int(edges[b + 1]))
