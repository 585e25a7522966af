"""Removal of repeated byte strings by a blockwise suffix array with a difference cover.

A byte is removed if a string of ``WIDTH`` bytes over it also starts in a
document with a smaller key. Documents are grouped into parts of bounded size.

1. The token of a string is the least hash of the ``SEED``-byte strings in it,
   so equal strings have equal tokens, and a token runs over several starts.
   Parts deal out their distinct tokens; those of one document only cannot
   mark a repeated string, and what they mark is left out: no suffix is sorted
   that has no partner.
2. The suffixes that are left, as the bytes of each token's run of starts, go
   to suffix buckets by token. Equal runs within a part are one run; all but its
   smallest document are known repeats and are not sent, so a passage that
   many documents share comes once from each part.
3. A bucket is sorted at a time: by the first ``HEAD`` bytes, then, where those
   tie, by the ranks of a difference cover sample. The suffixes at places in
   the cover (modulo ``PERIOD``) are ranked beforehand; for any two suffixes
   there is a shift below ``PERIOD`` that takes both into the sample, and their
   ranks there decide. Neighbours in the order that share ``WIDTH`` bytes are
   equal strings; those in a document above the smallest one are removed.

A null text is empty. Rows that share a key, or have none, do not remove each
other; a row without key counts as the largest. Strings are judged on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe.llm import packing, textops
from caseframe.llm.jaccard import with_ids

WIDTH = 50
SEED = 24
HEAD = 32
#: A perfect difference set: every difference modulo 31 is one of two members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Text bytes of a part and of a suffix bucket: they set how many there are, nothing else.
PART_BYTES = 16 << 20
BUCKET_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
#: A bucket is received whole and sorted in so many smaller ones, by further bits of the token.
SUB_BITS = 4
LAST = np.iinfo(np.int64).max


def _shifts() -> np.ndarray:
    """The least shift that takes two places, by their remainders, into the cover."""
    member = np.isin(np.arange(PERIOD), COVER)
    at = np.arange(PERIOD)
    table = np.zeros((PERIOD, PERIOD), np.int64)
    for shift in range(PERIOD - 1, -1, -1):
        both = member[(at + shift) % PERIOD]
        table[both[:, None] & both[None, :]] = shift
    return table


SHIFT = _shifts()


def words_at(raw: np.ndarray, swap: bool = True) -> np.ndarray:
    """The eight bytes at each place as a number, in byte order if ``swap``; zeros beyond the end."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    view = np.ndarray((len(raw),), "<u8", padded, 0, (1,))
    return view.byteswap() if swap else view.copy()


def string_tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, row and token of every string of ``WIDTH`` bytes that lies in one row."""
    n = len(raw) - WIDTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    w = words_at(raw, swap=False)
    least = textops.mix(textops.mix(w[:-16] * textops.ODD + w[8:-8]) * textops.ODD + w[16:])
    size, want = 1, WIDTH - SEED + 1
    while 2 * size <= want:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: n], least[want - size : want - size + n])
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(rows[:n] == rows[WIDTH - 1 :])
    return starts, rows[starts], textops.mix(least[starts]) >> np.uint64(64 - packing.TOKEN_BITS)


def _runs(starts: np.ndarray, rows: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Edges of the runs of starts that follow each other with one token in one row."""
    cut = (np.diff(starts) != 1) | (np.diff(rows) != 0) | (token[1:] != token[:-1])
    return np.concatenate(([0], np.flatnonzero(cut) + 1, [len(starts)])) if len(starts) else np.zeros(1, np.int64)


def _each(table: pa.Table, limit: int):
    for batch in table.combine_chunks().to_batches():
        yield from textops.slices(batch, "text", limit)


def _deal(table: pa.Table, bits: int) -> pa.Table:
    """Of one part: its distinct tokens by bucket, and whether two of its documents have them."""
    tokens, owners = [], []
    for part in _each(table, textops.CHUNK_BYTES):
        starts, rows, token = string_tokens(*textops.text_buffer(part.column("text")))
        first = _runs(starts, rows, token)[:-1]
        ids = part.column("id").to_numpy()[rows[first]] if len(first) else np.zeros(0, np.int64)
        tokens.append(token[first])
        owners.append(ids)
    token, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tokens, owners))
    order = np.lexsort((owner, token))
    token, owner = token[order].astype(np.uint64), owner[order]
    new = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
    several = np.maximum.reduceat(owner, new) != np.minimum.reduceat(owner, new) if len(new) else np.zeros(0, bool)
    token = token[new]
    found = [(b, packing.pack(token[at], several[at])) for b, at in packing.by_bucket((token >> np.uint64(packing.TOKEN_BITS - bits)).astype(np.int64), 1 << bits)]
    part = table.column("part")[0].as_py()
    return pa.table({"bucket": pa.array([b for b, _ in found], pa.int32()), "part": pa.array([part] * len(found), pa.int64()), "blob": pa.array([x for _, x in found], pa.binary())})


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket: for each part, its tokens that two documents have."""
    parts = table.column("part").to_pylist()
    blobs = [packing.unpack(b.as_py(), 2) for b in table.column("blob")]
    token, several = (np.concatenate([b[k] for b in blobs]) for k in (0, 1))
    of = np.repeat(np.arange(len(blobs)), [len(b[0]) for b in blobs])
    order = np.argsort(token, kind="stable")
    kinds, at = np.unique(token, return_inverse=True)
    shared = (np.bincount(at, minlength=len(kinds)) > 1) | (np.bincount(at, several, minlength=len(kinds)) > 0)
    order = order[shared[at[order]]]
    order = order[np.argsort(of[order], kind="stable")]
    found = [(parts[k], packing.pack(token[order][span])) for k, span in packing.by_bucket(of[order], len(parts))]
    return pa.table({"part": pa.array([p for p, _ in found], pa.int64()), "blob": pa.array([x for _, x in found], pa.binary())})


SENT = "bucket int, part long, local boolean, meta binary, body binary"


def _suffixes(table: pa.Table, blobs: pa.Table, bits: int) -> pa.Table:
    """Of one part: the runs of starts to be sorted by suffix bucket, and the repeats known within the part."""
    columns: list[list] = [[], [], [], [], []]
    shared = np.sort(np.concatenate([packing.unpack(b.as_py(), 1)[0] for b in blobs.column("blob")])) if blobs.num_rows else np.zeros(0, np.uint64)
    if table.num_rows and len(shared):
        number, pieces = [], []
        for part in _each(table, SLICE_BYTES):
            raw, offsets = textops.text_buffer(part.column("text"))
            starts, rows, token = string_tokens(raw, offsets)
            edges = _runs(starts, rows, token)
            first, last = edges[:-1], edges[1:] - 1
            at = np.minimum(np.searchsorted(shared, token[first]), len(shared) - 1)
            keep = shared[at] == token[first]
            first, last = first[keep], last[keep]
            a, b, row = starts[first], starts[last] + WIDTH, rows[first]
            number.append(
                np.stack([
                    token[first].view(np.int64), textops.segment_hash(raw, a, b).view(np.int64), part.column("order").to_numpy()[row],
                    part.column("id").to_numpy()[row], a - offsets[row], b - a,
                ])
            )
            pieces.append(raw[_ranges(a, b - a)])
        token, mark, rank, ids, start, length = np.concatenate(number, axis=1)
        body = np.concatenate(pieces)
        begin = np.cumsum(length) - length
        order = np.lexsort((rank, mark, length, token.view(np.uint64)))
        same = (np.diff(token[order]) == 0) & (np.diff(mark[order]) == 0) & (np.diff(length[order]) == 0)
        head = np.flatnonzero(np.concatenate(([True], ~same))) if len(order) else np.zeros(0, np.int64)
        least = np.repeat(rank[order][head], np.diff(np.append(head, len(order))))
        repeat = order[rank[order] > least]
        send = order[rank[order] == least]
        part_id = table.column("part")[0].as_py()
        if len(repeat):
            repeat = repeat[np.argsort(ids[repeat].view(np.uint64), kind="stable")]
            meta = packing.pack(ids[repeat], start[repeat], start[repeat] + length[repeat])
            _add(columns, part_id % (1 << bits), part_id, True, meta, b"")
        bucket = (token.view(np.uint64)[send] >> np.uint64(packing.TOKEN_BITS - bits)).astype(np.int64)
        send = send[np.lexsort((ids[send].view(np.uint64), bucket))]
        bucket = np.sort(bucket)
        sub = token.view(np.uint64) >> np.uint64(packing.TOKEN_BITS - bits - SUB_BITS) & np.uint64((1 << SUB_BITS) - 1)
        squeeze = zstandard.ZstdCompressor(level=3)
        for k, span in packing.by_bucket(bucket, 1 << bits):
            of = send[span]
            _add(columns, k, part_id, False, packing.pack(ids[of], rank[of], start[of], length[of], sub[of]), squeeze.compress(body[_ranges(begin[of], length[of])].tobytes()))
    types = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["bucket", "part", "local", "meta", "body"])


def _add(columns: list[list], *values) -> None:
    for column, value in zip(columns, values):
        column.append(value)


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after another."""
    return np.arange(int(length.sum())) + np.repeat(begin - (np.cumsum(length) - length), length)


def suffix_order(text: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by ``WIDTH`` bytes or more, and which equal the one before in ``WIDTH`` bytes.

    ``ends``: for each place of ``text`` the end of its run; bytes beyond it count as zero.
    """
    base = words_at(text)
    room = ends - np.arange(len(text))

    def word(at: np.ndarray, shift: int, size: int = 8) -> np.ndarray:
        """Bytes ``shift`` .. ``shift + size`` of the suffixes, zero beyond their run."""
        left = np.clip(room[at] - shift, 0, size)
        value = base[np.minimum(at + shift, len(text) - 1)]
        cut = (np.uint64(8) - left.astype(np.uint64)) * np.uint64(8)
        return np.where(left > 0, value >> np.minimum(cut, np.uint64(63)) << np.minimum(cut, np.uint64(63)), np.uint64(0))

    every = np.arange(len(text))
    sampled = np.isin(every % PERIOD, COVER)
    places = every[sampled]
    ranks = np.zeros(len(text) + PERIOD, np.int64)
    keys = [word(places, s, min(8, WIDTH - s)) for s in range(0, WIDTH, 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(places), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    ranks[places[order]] = np.cumsum(new) + 1

    heads = [word(starts, s) for s in range(0, HEAD, 8)]
    order = np.lexsort(heads[::-1])
    new = np.ones(len(starts), bool)
    if len(starts):
        new[1:] = False
    for h in heads:
        new[1:] |= h[order][1:] != h[order][:-1]
    group = np.cumsum(new)
    # split each tie by comparison with its middle suffix, until what is left is equal to it
    todo = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else np.zeros(0, np.int64)
    group = group[todo]
    while len(todo):
        own = starts[order[todo]]
        edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        pivot = np.repeat(own[(edge[:-1] + edge[1:]) // 2], np.diff(edge))
        shift = SHIFT[pivot % PERIOD, own % PERIOD]
        side = np.sign(ranks[own + shift] - ranks[pivot + shift])
        resort = np.lexsort((side, group))
        order[todo] = order[todo][resort]
        group, side = group[resort], side[resort]
        group = np.cumsum(np.concatenate(([True], (group[1:] != group[:-1]) | (side[1:] != side[:-1]))))
        open_ties = (side != 0) & (np.bincount(group)[group] > 1)
        todo, group = todo[open_ties], group[open_ties]
    equal = np.ones(len(starts), bool)
    equal[:1] = False
    at = starts[order]
    for s in range(0, WIDTH, 8):
        k = word(at, s, min(8, WIDTH - s))
        equal[1:] &= k[1:] == k[:-1]
    return order, equal


def _repeats(text: np.ndarray, rank: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes with strings of a smaller rank: number of the run, first and last byte within it."""
    begin, count = np.cumsum(length) - length, length - WIDTH + 1
    run = np.repeat(np.arange(len(length)), count)
    starts = _ranges(begin, count)
    order, equal = suffix_order(text, np.repeat(begin + length, length), starts)
    first = np.flatnonzero(~equal)
    ranks = rank[run[order]]
    least = np.repeat(np.minimum.reduceat(ranks, first), np.diff(np.append(first, len(order))))
    gone = np.zeros(len(starts), bool)
    gone[order] = ranks > least
    at = np.flatnonzero(gone)
    cut = np.ones(len(at), bool)
    cut[1:] = (np.diff(at) != 1) | (np.diff(run[at]) != 0)
    head = at[cut]
    tail = at[np.append(np.flatnonzero(cut)[1:], len(at)) - 1] if len(at) else at
    return run[head], starts[head] - begin[run[head]], starts[tail] - begin[run[head]] + WIDTH


def _sorted_bucket(table: pa.Table) -> pa.Table:
    """Of one suffix bucket: the byte ranges that repeat a smaller document, by part."""
    columns: list[list] = [[], []]
    meta, bodies, owner = [], [], []
    unzip = zstandard.ZstdDecompressor()
    for part, local, m, body in zip(*(table.column(c).to_pylist() for c in ("part", "local", "meta", "body"))):
        if local:
            _add(columns, part, m)
            continue
        meta.append(packing.unpack(m, 5))
        bodies.append(np.frombuffer(unzip.decompress(body), np.uint8))
        owner.append(np.full(len(meta[-1][0]), part, np.int64))
    if meta:
        ids, rank, start, length, sub = (np.concatenate([m[k] for m in meta]).astype(np.int64) for k in range(5))
        part, text = np.concatenate(owner), np.concatenate(bodies)
        begin = np.cumsum(length) - length
        found = []
        for k in np.unique(sub):
            of = np.flatnonzero(sub == k)
            run, a, b = _repeats(text[_ranges(begin[of], length[of])], rank[of], length[of])
            found.append(np.stack([of[run], start[of[run]] + a, start[of[run]] + b]))
        of, a, b = np.concatenate(found, axis=1)
        order = np.lexsort((ids[of].view(np.uint64), part[of]))
        names, edge = np.unique(part[of][order], return_index=True)
        for k, p in enumerate(names.tolist()):
            s = order[edge[k] : edge[k + 1] if k + 1 < len(edge) else len(order)]
            _add(columns, p, packing.pack(ids[of][s], a[s], b[s]))
    return pa.table({"part": pa.array(columns[0], pa.int64()), "blob": pa.array(columns[1], pa.binary())})


def _cut(table: pa.Table, blobs: pa.Table, schema: T.StructType, texts: bool) -> pa.Table:
    """Of one part: its documents without the removed ranges."""
    from pyspark.sql.pandas.types import to_arrow_schema

    found = [packing.unpack(b.as_py(), 3) for b in blobs.column("blob")]
    ids, a, b = (np.concatenate([f[k] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for k in range(3))
    batches = []
    for part in _each(table, textops.CHUNK_BYTES):
        raw, offsets = textops.text_buffer(part.column("text"))
        own = part.column("id").to_numpy()
        by_id = np.argsort(own)
        at = np.minimum(np.searchsorted(own[by_id], ids), len(own) - 1)
        mine = own[by_id][at] == ids
        row = by_id[at[mine]]
        cover = np.zeros(len(raw) + 1, np.int64)
        np.add.at(cover, offsets[row] + a[mine], 1)
        np.add.at(cover, offsets[row] + b[mine], -1)
        gone = np.cumsum(cover[:-1]) > 0
        _, _, span_rows = textops.runs(gone, offsets)
        rows = np.repeat(np.arange(len(own)), np.diff(offsets))
        removed = np.bincount(rows[gone], minlength=len(own)).astype(np.int64)
        kept = memoryview(raw[~gone].tobytes())
        edges = np.concatenate(([0], np.cumsum(np.diff(offsets) - removed)))
        pieces = [bytes(kept[x:y]) for x, y in zip(edges[:-1], edges[1:])]
        last = pa.array(pieces, pa.binary()) if texts else pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string())
        batches.append(
            pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.bincount(span_rows, minlength=len(own)).astype(np.int64)), last],
                schema.names,
            )
        )
    return pa.Table.from_batches(batches, to_arrow_schema(schema))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans and ``kept`` (the bytes that are left).

    With ``texts=False`` the last column is ``kept_sha256`` instead.
    """
    rows, _ = with_ids(docs, key, text)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts, bits = size // PART_BYTES + 1, max(3, int(size // BUCKET_BYTES).bit_length())
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST)))
    by_part = rows.select("id", "doc_id", order.alias("order"), "text", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).groupBy("part")
    tokens = by_part.applyInArrow(lambda t: _deal(t, bits), "bucket int, part long, blob binary")
    shared = tokens.groupBy("bucket").applyInArrow(_repeated, "part long, blob binary")
    sent = by_part.cogroup(shared.groupBy("part")).applyInArrow(lambda t, b: _suffixes(t, b, bits), SENT)
    ranges = sent.groupBy("bucket").applyInArrow(_sorted_bucket, "part long, blob binary")
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
        T.StructField("kept", T.BinaryType()) if texts else T.StructField("kept_sha256", T.StringType()),
    ])
    out = by_part.cogroup(ranges.groupBy("part")).applyInArrow(lambda t, b: _cut(t, b, schema, texts), schema)
    return out.withColumnRenamed("doc_id", key)
