"""Patterns over chunked content: what a scan of the whole content finds, window by window.

A left-to-right scan resumes where its last match ended, which may lie in the
next window. A window therefore tells, for each place where a scan can enter it,
where that scan leaves it; only windows that can be left behind their end matter
to others. These maps are composed over stretches of ``STRETCH`` windows (and
stretches of stretches, with more ``LEVELS``), so that an object is followed
through groups of bounded size: up by composition, along the few top rows, and
down again to the windows. Content is never moved for it.

A scan enters a window no further than a match reaches, so a map has at most as
many steps as the longest match has bytes. Windows go through Python in slices
of ``SLICE_BYTES``, and places are arrays of numbers, whatever the number of
matches in a batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.functions import scan

STRETCH = 1024
#: Content whose maps or matches are held at once; a window is never cut.
SLICE_BYTES = 1 << 20
#: Levels of stretches: a top row stands for STRETCH ** LEVELS windows.
LEVELS = 1

_MAP = "uptos array<bigint>, leaves array<bigint>"
_ROWS = f"_object binary, no bigint, first bigint, {_MAP}"


def exits(rx: re.Pattern, data: bytes, lo: int, hi: int, reach: int = scan.MAX_REGEX_SPAN) -> list[tuple[int, int]]:
    """Where a left-to-right scan leaves [lo, hi), by the place where it enters.

    (upto, leave) pairs: a scan that enters at or before ``upto`` (and after the
    one before) leaves at ``leave``: the end of a match over the edge, or ``hi``.
    Scans from different places share their matches once they meet. No scan
    enters further than ``reach``, the longest match, behind ``lo``.
    """
    out: list[tuple[int, int]] = []
    leaves: dict[tuple[int, int], int] = {}
    enter, limit = lo, min(hi - 1, lo + reach)
    while enter <= limit:
        path, leave, first = [], hi, None
        for m in rx.finditer(data, enter):
            if m.start() >= hi:
                break
            first = m.start() if first is None else first
            if m.span() in leaves:
                leave = leaves[m.span()]
                break
            path.append(m.span())
            if m.end() > hi:
                leave = m.end()
                break
        for place in path:
            leaves[place] = leave
        if first is None:
            break
        if out and out[-1][1] == leave:
            out.pop()
        out.append((first, leave))
        enter = first + 1
    return [*out, (hi - 1, hi)]


def _sliced(columns: tuple[pa.Array, ...], work: Callable[..., tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """List offsets and the two flat arrays of ``work`` (content, numbers) of the rows, some rows at a time."""
    n, start = len(columns[0]), 0
    while start < n:
        ends, firsts, seconds, size, k = [0], [], [], 0, start
        while k < n and (k == start or size < SLICE_BYTES):
            data = columns[0][k].as_py()
            a, b = work(data, *(c[k].as_py() for c in columns[1:]))
            firsts.append(a)
            seconds.append(b)
            ends.append(ends[-1] + len(a))
            size += len(data)
            k += 1
        start = k
        yield pa.array(ends, pa.int32()), np.concatenate(firsts), np.concatenate(seconds)


def _left(uptos: np.ndarray, leaves: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where scans that arrive at ``place`` leave; one that arrives behind the window passes it by."""
    at = np.searchsorted(uptos, place)
    return np.where(at < len(uptos), leaves[np.minimum(at, len(uptos) - 1)], place)


def _extended(uptos: np.ndarray, leaves: np.ndarray, u: np.ndarray, v: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The map (uptos, leaves) followed by the map (u, v), for scans that arrive before ``limit``."""
    leaves = _left(u, v, leaves)
    beyond = u > uptos[-1]
    if uptos[-1] < limit and beyond.any():
        uptos, leaves = np.concatenate((uptos, u[beyond])), np.concatenate((leaves, v[beyond]))
    last = np.concatenate((leaves[1:] != leaves[:-1], [True]))
    uptos, leaves = uptos[last], leaves[last]
    enough = int(np.searchsorted(uptos, limit)) + 1
    return uptos[:enough], leaves[:enough]


def compose(rows: list[tuple[np.ndarray, np.ndarray]], first: int) -> tuple[np.ndarray, np.ndarray]:
    """One map for maps in order, for scans that arrive within a match's length of ``first``."""
    uptos, leaves = rows[0]
    for u, v in rows[1:]:
        uptos, leaves = _extended(uptos, leaves, u, v, first + scan.MAX_REGEX_SPAN)
    return uptos, leaves


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The named columns and the map of each row."""
    maps = []
    for name in ("uptos", "leaves"):
        column = batch.column(name)
        ends, flat = np.asarray(column.offsets), np.asarray(column.values)
        maps.append([flat[a:b] for a, b in zip(ends[:-1], ends[1:])])
    return zip(*(batch.column(n).to_pylist() for n in names), *maps)


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One map for the sorted rows of each stretch; one map is held."""
    now, out = None, []

    def made() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2))]
        return pa.RecordBatch.from_arrays(columns, ["_object", "no", "first", "uptos", "leaves"])

    for batch in batches:
        for name, up, first, u, v in _rows(batch, "_object", "up", "first"):
            if now is None or now[:2] != (name, up):
                out += [] if now is None else [now]
                now = (name, up, first, u, v)
            else:
                now = (*now[:3], *_extended(*now[3:], u, v, now[2] + scan.MAX_REGEX_SPAN))
        if len(out) >= 1000:
            yield made()
            out = []
    if now is not None:
        out.append(now)
        yield made()


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the scan comes to each of the sorted rows of a stretch, and leaves it."""
    now, at = None, np.int64(-1)
    for batch in batches:
        arrive, leave = [], []
        for name, up, place, u, v in _rows(batch, "_object", "up", "arrive"):
            if now != (name, up):
                now, at = (name, up), np.int64(-1 if place is None else place)
            arrive.append(int(at))
            at = _left(u, v, at)[()]
            leave.append(int(at))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_object"), batch.column("no"), pa.array(arrive, pa.int64()), pa.array(leave, pa.int64())],
            ["_object", "no", "arrive", "leave"],
        )


def followed(rows: DataFrame, levels: int = LEVELS, stretch: int = STRETCH) -> DataFrame:
    """(_object, no, arrive, leave): where the scan of each object comes to its windows and leaves them.

    ``rows``: _object, no, first (where the window begins), uptos, leaves, in
    places of the object. Windows that no scan leaves behind its end are left out.
    """
    told = "_object binary, no bigint, arrive bigint, leave bigint"
    if not levels:
        top = rows.withColumns({"up": F.lit(0).cast("long"), "arrive": F.lit(None).cast("long")})
        return top.repartition("_object").sortWithinPartitions("_object", "no").mapInArrow(_followed, told)
    # No key is null, so that the composing and the following read one exchange, without a filter in front of the join.
    up = rows.withColumn("up", F.expr(f"coalesce(no div {int(stretch)}, 0L)")).repartition("_object", "up")
    composed = up.sortWithinPartitions("_object", "up", "no").mapInArrow(_composed, _ROWS)
    above = followed(composed, levels - 1, stretch).select("_object", F.col("no").alias("up"), "arrive")
    joined = up.join(above, ["_object", "up"])
    return joined.repartition("_object", "up").sortWithinPartitions("_object", "up", "no").mapInArrow(_followed, told)


def _own_range(windows: DataFrame, size: int) -> DataFrame:
    """The bytes of a window that are its own, as places in its content; windows without any are left out."""
    lo = F.greatest(F.col("window_no") * size - F.col("base"), F.lit(0))
    hi = F.least((F.col("window_no") + 1) * size - F.col("base"), F.octet_length("content"))
    return windows.withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long")}).where("_lo < _hi")


def regex_hits(windows: DataFrame, pattern: str, size: int, levels: int = LEVELS, stretch: int = STRETCH) -> DataFrame:
    """Matches of one pattern that start in each window: the windows' columns, offset and span.

    ``windows`` come from ``cut_windows``: partitioned by _object and window_no.
    """
    scan.check_pattern(pattern)
    needed = scan.required_literal(pattern)
    own = _own_range(windows, size)
    own = own if needed is None else own.where(F.contains("content", F.lit(needed)))

    reach = scan.reach(pattern)

    @F.arrow_udf("struct<uptos:array<bigint>,leaves:array<bigint>>")
    def told(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        rx = re.compile(pattern.encode("latin-1"))

        def one(data: bytes, at: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            steps = np.array(exits(rx, data[: b + reach - 1], a, b, reach), np.int64)
            return at + steps[:, 0], at + steps[:, 1]

        for columns in batches:
            for ends, uptos, leaves in _sliced(columns, one):
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (uptos, leaves)]
                yield pa.StructArray.from_arrays(lists, ["uptos", "leaves"])

    @F.arrow_udf(scan.SPANS)
    def spans(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        rx = re.compile(pattern.encode("latin-1"))

        def places(data: bytes, at: int, end: int) -> Iterator[int]:
            for m in rx.finditer(data[: end + reach - 1], at):
                # An empty match behind the last byte of the content is the last window's.
                if m.start() >= end and not m.start() == end == len(data):
                    break
                yield m.start()
                yield m.end()

        def one(data: bytes, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
            both = np.fromiter(places(data, at, end), np.int64)
            return both[::2], both[1::2] - both[::2]

        for columns in batches:
            for ends, offsets, lengths in _sliced(columns, one):
                yield pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(offsets), pa.array(lengths)], ["offset", "span"]))

    # Nothing can be left behind the end of content.
    continued = own.where(F.octet_length("content") > F.col("_hi"))
    open_ends = (
        continued.select(
            "_object", F.col("window_no").alias("no"), (F.col("base") + F.col("_lo")).alias("first"),
            (F.col("base") + F.col("_hi")).alias("end"), F.explode(F.array(told("content", "base", "_lo", "_hi"))).alias("_m"),
        )
        .select("_object", "no", "first", "end", "_m.uptos", "_m.leaves")
        .where(F.array_max("leaves") > F.col("end"))
        .drop("end")
    )
    left = followed(open_ends, levels, stretch)
    entered = left.select("_object", (F.col("no") + 1).alias("window_no"), F.col("leave").alias("_place"))
    # A window that begins behind a gap, inside the margin of the next, is entered at its start.
    begins = F.col("base") + F.col("_lo") == F.col("window_no") * size
    enter = F.when(begins & F.col("_place").isNotNull(), F.greatest(F.col("_place") - F.col("base"), F.col("_lo"))).otherwise(F.col("_lo"))
    joined = own.join(entered, ["_object", "window_no"], "left").withColumn("_enter", enter)
    found = joined.withColumn("_h", F.explode(spans("content", "_enter", "_hi"))).select(
        *windows.columns, F.col("_h.offset").alias("offset"), F.col("_h.span").alias("span")
    )
    # An empty match at the very start has no extent and is not a hit.
    return found.where("base + offset + span > 0")
