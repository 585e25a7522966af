"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

The text is split by the JVM's regular expressions. Each partition encodes its
distinct pieces: a recursive query lays out one row per token position, joins
the merge table, and contracts the leftmost pair of least rank of every piece,
once a round, until no pair merges; a piece without a pair leaves the recursion.
Decoding is an ordered aggregation of the token bytes. Pieces of more than
``LONG_PIECE`` bytes would need as many rounds over all their positions as they
have merges; they go through the same merges with a heap.

Memory: text is taken in slices, and only its pieces go to the workers (callers
pin ``BATCH`` for that, so that a batch holds about one slice). A recursive query holds the rows of all its
rounds, at most half the square of its length for a piece, so a query takes
pieces up to ``QUERY_ROWS`` of these. What a worker remembers is bounded in
bytes, and DuckDB in ``MEMORY_LIMIT``.

Null and empty texts have no tokens; text is taken whole; rows are independent,
so repeated rows give repeated results. Other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe.llm import textops

LONG_PIECE = 256
#: Rows of one query, and bytes of the pieces remembered between batches: both bound memory, not results.
QUERY_ROWS = 1 << 20
REMEMBERED_BYTES = 64 << 20
#: What a remembered piece costs besides its bytes.
ENTRY_BYTES = 260
MEMORY_LIMIT = "400MB"
#: Text whose pieces are looked up at once: a query has a fixed cost for each round, and a slice its arrays.
SLICE_BYTES = 4 << 20
#: Arrow batches of such a slice: the pieces and their offsets take some two times the bytes of the text.
BATCH = "6m"
DECODED_ROWS = 1024
_SIZE = "__size"
_PIECES = "__pieces"
_UNKNOWN = "__unknown"

CONTRACT = """
WITH RECURSIVE state AS (
    SELECT w, p, t, 0 AS round FROM symbols
    UNION ALL
    (WITH pair AS (
        SELECT a.w, a.p, a.t, a.round, m.rank::BIGINT * 65536 + a.p AS pick
        FROM state a
        LEFT JOIN state n ON n.w = a.w AND n.p = a.p + 1
        LEFT JOIN merges m ON m.pair = a.t::BIGINT * 65536 + n.t),
    best AS (SELECT w, min(pick) AS pick FROM pair WHERE pick IS NOT NULL GROUP BY w)
    SELECT w,
           (CASE WHEN p > best.pick % 65536 THEN p - 1 ELSE p END)::INTEGER AS p,
           CASE WHEN p = best.pick % 65536 THEN (best.pick // 65536)::INTEGER ELSE t END AS t,
           round + 1 AS round
    FROM pair JOIN best USING (w)
    WHERE p <> best.pick % 65536 + 1)
), last AS (SELECT w, max(round) AS round FROM state GROUP BY w)
SELECT w, list(t ORDER BY p) AS ids FROM state JOIN last USING (w, round) GROUP BY w ORDER BY w
"""
DECODE = """
SELECT w, unhex(string_agg(v.hex, '' ORDER BY p)) AS bytes
FROM (SELECT w, unnest(ids) AS t, generate_subscripts(ids, 1) AS p FROM encoded) JOIN vocabulary v USING (t)
GROUP BY w ORDER BY w
"""


@dataclass
class Vocabulary:
    """Token bytes by id; the merge table follows from them (rank of a pair: id of the joined bytes)."""

    tokens: list[bytes]
    ranks: dict[bytes, int] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.ranks = {t: i for i, t in enumerate(self.tokens)}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        tokens = [b""] * (max(int(i) for _, i in pairs) + 1)
        for token, i in pairs:
            tokens[int(i)] = base64.b64decode(token)
        return cls(tokens)

    def merges(self) -> pa.Table:
        pairs, ranks = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left * 65536 + right)
                    ranks.append(rank)
        return pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(ranks, pa.int32())})


def java_pattern(pattern: str) -> str:
    """The split pattern with Unicode white space spelled out for the JVM."""
    return pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def with_pieces(df: DataFrame, pattern: str, text: str) -> DataFrame:
    """Add the pieces and the bytes of the text; a text with code points unknown to the JVM is split in Python instead."""
    unknown = F.coalesce(F.col(text).rlike(r"\p{Cn}"), F.lit(False))
    pieces = F.regexp_extract_all(F.col(text), F.lit(java_pattern(pattern)), F.lit(0))
    return df.withColumns({
        _PIECES: F.when(unknown, F.array().cast("array<string>")).otherwise(pieces),
        _UNKNOWN: F.when(unknown, F.col(text)),
        _SIZE: F.octet_length(text),
    })


def runs(pieces: list[bytes], cost: Callable[[int], int]) -> Iterator[list[bytes]]:
    """Runs of pieces whose costs (of their lengths) add up to ``QUERY_ROWS`` at most, one piece at least."""
    run, total = [], 0
    for piece in pieces:
        rows = cost(len(piece))
        if run and total + rows > QUERY_ROWS:
            yield run
            run, total = [], 0
        run.append(piece)
        total += rows
    if run:
        yield run


def all_rounds(length: int) -> int:
    return length * (length + 1) // 2


def one_round(length: int) -> int:
    return length


class Encoder:
    """One partition's DuckDB tables and what it has encoded so far."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.vocabulary = Vocabulary(tokens)
        self.pattern = pattern
        # What was met since the last change of generations, and in the one before.
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, bytes]] = {}
        self.known_bytes = 0
        self.byte_ids = np.array([self.vocabulary.ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect()
        self.con.execute(f"SET threads = 1; SET memory_limit = '{MEMORY_LIMIT}'; SET temp_directory = ''")
        merges = self.vocabulary.merges()  # noqa: F841 (read by name)
        vocabulary = pa.table({"t": pa.array(range(len(tokens)), pa.int32()), "hex": [t.hex() for t in tokens]})  # noqa: F841
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")

    def contract(self, pieces: list[bytes]) -> list[bytes]:
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        at = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        words = np.repeat(np.arange(len(pieces)), lengths)
        symbols = pa.table({"w": words.astype(np.int32), "p": at.astype(np.int32), "t": self.byte_ids[raw]})  # noqa: F841
        found = one_column(self.con.sql(CONTRACT).to_arrow_table(), "ids")
        ids = np.asarray(found.flatten()).astype("<u4")
        ends = np.cumsum(np.asarray(pc.list_value_length(found)))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]

    def heap(self, piece: bytes) -> bytes:
        """The same merges for one long piece: a heap of (rank, position) over a linked list."""
        tokens, ranks = [piece[i : i + 1] for i in range(len(piece))], self.vocabulary.ranks
        after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        offer = lambda i: (ranks.get(tokens[i] + tokens[after[i]]), i) if i >= 0 and after[i] < len(tokens) else (None, i)
        queue = [x for x in map(offer, range(len(piece))) if x[0] is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            if not tokens[i] or offer(i)[0] != rank:
                continue
            j = after[i]
            tokens[i], tokens[j], after[i] = tokens[i] + tokens[j], b"", after[j]
            if after[i] < len(tokens):
                before[after[i]] = i
            for k in (before[i], i):
                if (x := offer(k))[0] is not None:
                    heapq.heappush(queue, x)
        return np.array([ranks[t] for t in tokens if t], "<u4").tobytes()

    def decode(self, ids: list[bytes]) -> list[bytes]:
        lists = [np.frombuffer(x, "<u4") for x in ids]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
        values = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
        encoded = pa.table({"w": pa.array(range(len(ids)), pa.int32()), "ids": pa.ListArray.from_arrays(offsets, values)})  # noqa: F841
        return self.con.sql(DECODE).to_arrow_table()["bytes"].to_pylist() if ids else []

    def lookup(self, pieces: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Ids (little-endian 32 bit) and decoded bytes of each distinct piece."""
        found = {}
        for p in pieces:
            entry = self.known.get(p) or self.older.get(p)
            if entry:
                found[p] = entry
        whole = [p for p in pieces if p not in found and p in self.vocabulary.ranks]
        rest = [p for p in pieces if p not in found and p not in self.vocabulary.ranks]
        ids = [self.vocabulary.ranks[p].to_bytes(4, "little") for p in whole]
        short = [p for p in rest if len(p) <= LONG_PIECE]
        long = [p for p in rest if len(p) > LONG_PIECE]
        for run in runs(short, all_rounds):
            ids += self.contract(run)
        ids += [self.heap(p) for p in long]
        at = 0
        for run in runs(whole + short + long, one_round):
            part, at = ids[at : at + len(run)], at + len(run)
            for p, code, plain in zip(run, part, self.decode(part)):
                found[p] = code, p if plain == p else plain  # one object for both
        self.remember(found)
        both = [found[p] for p in pieces]
        return [x[0] for x in both], [x[1] for x in both]

    def remember(self, found: dict[bytes, tuple[bytes, bytes]]) -> None:
        """Keep what was met; the generation before goes when this one is full."""
        for p, entry in found.items():
            if p not in self.known:
                self.known[p] = entry
                self.known_bytes += ENTRY_BYTES + len(p) + len(entry[0])
                if self.known_bytes > REMEMBERED_BYTES // 2:
                    self.older, self.known, self.known_bytes = self.known, {}, 0

    def split(self, batch: pa.RecordBatch) -> pa.ListArray:
        pieces = batch.column(_PIECES)
        odd = batch.column(_UNKNOWN)
        if odd.null_count == len(odd):
            return pieces
        import regex

        find = regex.compile(self.pattern).findall
        return pa.array([p if t is None else find(t) for p, t in zip(pieces.to_pylist(), odd.to_pylist())], pa.list_(pa.string()))

    def batch(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Per row: end of its ids in the flat id array, that array, flat decoded pieces, end of its pieces."""
        pieces = self.split(batch)
        counts = np.asarray(pc.fill_null(pc.list_value_length(pieces), 0)).astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        at = np.asarray(coded.indices)
        ids, decoded = self.lookup([s.encode() for s in coded.dictionary.to_pylist()])
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        flat = pa.array(ids, pa.binary()).take(pa.array(at, pa.int32()))
        values = np.frombuffer(flat.buffers()[2], "<u4")[: int(lengths[at].sum())] if len(at) else np.zeros(0, "<u4")
        ends = np.cumsum(counts)
        id_ends = np.concatenate(([0], np.cumsum(lengths[at])))[ends]
        return id_ends, values, pa.array(decoded, pa.binary()).take(pa.array(at, pa.int32())), ends


def one_column(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _joined_sha256(pieces: pa.Array, ends: np.ndarray) -> pa.Array:
    """SHA-256 of each row's decoded pieces behind each other; ``ends`` count the pieces up to each row's last."""
    _, offsets, data = pieces.buffers()
    places = np.concatenate(([0], ends))
    cut = np.frombuffer(offsets, np.int32)[places] if len(pieces) else np.zeros(len(places), np.int32)
    raw = memoryview(data or b"")
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:])], pa.string())


def _apply(df: DataFrame, vocabulary: Vocabulary, pattern: str, text: str, keep: Sequence[str], schema: T.StructType, out) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.tokens)  # as long as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(shared.value, pattern)
            for part in textops.slices(batch, _SIZE, SLICE_BYTES):
                yield out(part, encoder)
            pa.default_memory_pool().release_unused()  # a batch's columns are not kept beside the next ones

    return with_pieces(df, pattern, text).select(*keep, _SIZE, _PIECES, _UNKNOWN).mapInArrow(run, schema)


def encode(
    df: DataFrame,
    vocabulary: Vocabulary,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    decoded_sha256: str | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """All columns (or those to ``keep``), the token ids of the text as an array, and on request the SHA-256 of the bytes decoded from them."""
    made = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    made += [T.StructField(decoded_sha256, T.StringType())] if decoded_sha256 else []
    names = [n for n in (df.columns if keep is None else keep) if n not in {m.name for m in made}]
    schema = T.StructType([*(df.schema[n] for n in names), *made])

    def out(batch: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
        ends, values, pieces, piece_ends = encoder.batch(batch)
        offsets = np.concatenate(([0], ends)).astype(np.int32)
        columns = [*(batch.column(n) for n in names), pa.ListArray.from_arrays(offsets, values.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns + ([_joined_sha256(pieces, piece_ends)] if decoded_sha256 else []), schema.names)

    return _apply(df, vocabulary, pattern, text, names, schema, out)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns, and the bytes of the ids; no or null ids give no bytes, an id outside the vocabulary fails."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.tokens)
    keep = [f for f in df.schema.fields if f.name != decoded]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(shared.value, "")
            for start in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(start, DECODED_ROWS)
                rows = [np.asarray(x or [], "<u4") for x in part.column(ids).to_pylist()]
                if any(len(r) and r.max() >= len(shared.value) for r in rows):
                    raise ValueError("an id is not in the vocabulary")
                full = [i for i, r in enumerate(rows) if len(r)]
                out = [b""] * len(rows)
                for run in runs([rows[i].tobytes() for i in full], one_round):
                    for i, b in zip(full, encoder.decode(run)):
                        out[i] = b
                    full = full[len(run) :]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(out, pa.binary())], [*names, decoded])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(decoded, T.BinaryType())]))


def digests(df: DataFrame, vocabulary: Vocabulary, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids and of the bytes decoded from them."""
    schema = T.StructType([
        df.schema[key], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def out(batch: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
        ends, values, pieces, piece_ends = encoder.batch(batch)
        raw, at = memoryview(values.tobytes()), np.concatenate(([0], ends))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.RecordBatch.from_arrays(
            [
                batch.column(key), pa.array(np.diff(at), pa.int64()),
                pa.array([sha(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])], pa.string()),
                _joined_sha256(pieces, piece_ends),
            ],
            schema.names,
        )

    return _apply(df, vocabulary, pattern, text, [key], schema, out)
