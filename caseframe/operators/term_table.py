"""Term lists of any length, matched where the content lies.

The terms come to the content, not the content to the terms: they are hashed
into shards of bounded size, a shard is sent to every task, and one pass over
the content finds and verifies its hits. Each term is represented by an anchor,
a stretch of fixed length whose place depends on the term, so that common
beginnings do not share one. A bitmap keeps out the places of the content that
start no anchor; the anchors found there are looked up, and the terms behind
them are compared in full, eight bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caseframe.functions import scan

#: Anchor lengths, longest first.
ANCHORS = (8, 4, 3, 2, 1)
#: Bytes of the terms that one pass over the content takes.
SHARD_BYTES = 32 << 20
FILTER_BITS = 20
#: Places of content handled at once, and hits in one batch of rows.
PLACES = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)


def _masks(n: np.ndarray) -> np.ndarray:
    """Masks of the first ``n`` (1 to 8) bytes of a little-endian number."""
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * n.astype(np.uint64))


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; ``data`` ends with seven bytes of padding."""
    return np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))


def _slots(anchors: np.ndarray) -> np.ndarray:
    mixed = anchors * ODD
    return (mixed ^ (mixed >> np.uint64(32))) * ODD >> np.uint64(64 - FILTER_BITS)


@dataclass
class Terms:
    """One shard of terms, with kinds, sorted for lookup by anchor."""

    terms: list[bytes]
    kinds: list[str]

    def __post_init__(self) -> None:
        sizes = np.array([len(t) for t in self.terms], np.int64)
        raw = np.frombuffer(b"".join(self.terms) + bytes(8), np.uint8)
        starts = np.cumsum(sizes) - sizes
        loads = _loads(raw)
        n = np.ones(len(sizes), np.int64)
        for length in reversed(ANCHORS):
            n[sizes >= length] = length
        head = loads[starts] & _masks(np.minimum(sizes, 8))
        tail = loads[starts + np.maximum(sizes - 8, 0)] & _masks(np.minimum(sizes, 8))
        # Where the anchor stands follows from the term's ends and length.
        place = ((head ^ (tail * ODD) ^ sizes.astype(np.uint64)) * ODD >> np.uint64(33)).astype(np.int64) % (sizes - n + 1)
        anchor = loads[starts + place] & _masks(n)
        order = np.lexsort((anchor, n))
        self.terms = [self.terms[i] for i in order]
        self.kinds = [self.kinds[i] for i in order]
        self.raw, self.starts, self.sizes = raw, starts[order], sizes[order]
        self.place, self.anchor, n = place[order], anchor[order], n[order]
        self.lengths = [(int(k), int(np.searchsorted(n, k)), int(np.searchsorted(n, k, "right"))) for k in np.unique(n)]
        self.filters = {}
        for k, a, b in self.lengths:
            self.filters[k] = np.zeros(1 << FILTER_BITS, bool)
            self.filters[k][_slots(self.anchor[a:b])] = True

    def candidates(self, loads: np.ndarray, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, term) of what the anchors in places [first, last) propose."""
        here = loads[first:last]
        for n, a, b in self.lengths:
            value = here & _masks(np.array([n]))[0]
            at = np.flatnonzero(self.filters[n][_slots(value)])
            value = value[at]
            left, right = (np.searchsorted(self.anchor[a:b], value, side) for side in ("left", "right"))
            count = right - left
            term = np.repeat(left + a, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            yield np.repeat(at + first, count) - self.place[term], term

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, start, term) of every occurrence within a row; ``data`` is padded, ``offsets`` bound the rows."""
        loads, own = _loads(data), _loads(self.raw)
        for first in range(0, int(offsets[-1]), PLACES):
            for start, term in self.candidates(loads, first, min(first + PLACES, int(offsets[-1]))):
                row = np.searchsorted(offsets, start, side="right") - 1
                inside = (start >= 0) & (start + self.sizes[term] <= offsets[np.minimum(row + 1, len(offsets) - 1)])
                row, start, term = row[inside], start[inside], term[inside]
                done = 0
                left = np.arange(len(term))
                equal = np.ones(len(term), bool)
                while len(left):
                    t, s = term[left], start[left]
                    mask = _masks(np.minimum(self.sizes[t] - done, 8))
                    same = (loads[s + done] & mask) == (own[self.starts[t] + done] & mask)
                    equal[left[~same]] = False
                    done += 8
                    left = left[same & (self.sizes[t] > done)]
                if equal.any():
                    yield row[equal], start[equal], term[equal]


def _around(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The bytes [lo, hi) of each hit."""
    size = hi - lo
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data[at].tobytes())])


def _content_slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("content")), 0)).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def shard_hits(df: DataFrame, shared, context: bool) -> DataFrame:
    """Hits of one broadcast shard: the columns of ``df`` but for content, term, term_kind, offset, span, around."""
    keep = [f for f in df.schema.fields if f.name != "content"]
    names = [f.name for f in keep]
    long, string = T.LongType(), T.StringType()
    found = [("term", string), ("term_kind", string), ("offset", long), ("span", long), ("around", T.BinaryType())]
    schema = T.StructType([*keep, *[T.StructField(n, t) for n, t in found]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: Terms = shared.value
        texts = pa.array([t.decode("latin-1") for t in terms.terms], pa.string())
        kinds = pa.array(terms.kinds, pa.string())
        for batch in batches:
            for part in _content_slices(batch):
                content = pc.fill_null(part.column("content"), b"")
                offsets = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(content)).astype(np.int64))))
                data = np.frombuffer(b"".join(content.to_pylist()) + bytes(8), np.uint8)
                for row, start, term in terms.hits(data, offsets):
                    end, size = start + terms.sizes[term], len(row)
                    lo = np.maximum(start - scan.CONTEXT_RADIUS, offsets[row])
                    hi = np.minimum(end + scan.CONTEXT_RADIUS, offsets[row + 1])
                    numbers = pa.array(term)
                    columns = [texts.take(numbers), kinds.take(numbers), pa.array(start - offsets[row]), pa.array(terms.sizes[term])]
                    columns.append(_around(data, lo, hi) if context else pa.nulls(size, pa.binary()))
                    kept = part.select(names).take(pa.array(row)).columns if names else []
                    yield pa.RecordBatch.from_arrays([*kept, *columns], schema=arrow)

    return df.mapInArrow(run, schema)


def table_hits(df: DataFrame, terms: DataFrame, context: bool = True, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of ``df`` times the hits of a term table (term binary, kind string): every place of every term.

    The columns of ``df`` but for content, term, term_kind, offset, span,
    context and attributes. Only a shard of terms is ever held in one place; the
    content is read once for each shard.
    """
    listed = terms.where(F.octet_length("term") > 0).select("term", "kind").distinct()
    total = listed.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    shards = -(-total // shard_bytes) or 1
    shard = F.pmod(F.xxhash64("term", "kind"), F.lit(shards))
    out = None
    for k in range(shards):
        rows = listed.where(shard == k).collect()
        here = Terms([bytes(r["term"]) for r in rows], [r["kind"] for r in rows])
        one = shard_hits(df, df.sparkSession.sparkContext.broadcast(here), context)
        out = one if out is None else out.unionByName(one)
    return out.withColumns({"context": F.decode("around", "ISO-8859-1"), "attributes": F.lit("{}")}).drop("around")
