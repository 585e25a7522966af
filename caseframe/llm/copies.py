"""Exact copies by a Golomb-coded exchange of fingerprints.

The documents stay where they are while their fingerprints (the leading bits of
SHA-256) travel. A part is a run of consecutive rows of one file; it sends each
owner of a fingerprint range its sorted distinct fingerprints as Golomb-Rice
coded differences. An owner merges what it got and answers every sender with one
bit a fingerprint: set if another part has it too. The part turns the answers
into one bit a row. A second reading of the documents passes on the texts of the
marked rows only, and these are grouped by their bytes, so a fingerprint that
two different texts share costs work, not a wrong result.

Owners hold ``OWNER_ROWS`` fingerprints on average. A sender deals to at most
2^``STEP`` ranges; where more owners are needed, relays gather the messages of
many parts for one range and deal them out again, and pass the answers back. A
fingerprint that holds a third of all rows is sent once by a part and once by a
relay, and equal texts are counted in every map task before they move.

Null is an empty text; texts are taken whole. Rows with one ``doc_id``, or with
none, are rows of their own: of equal texts exactly one row stays, one with the
largest ``doc_id`` (a null counts as less than any other, and rows with the same
text and ``doc_id`` do not differ in the result). An empty table gives an empty
table. Columns other than key and text do not matter, whatever their names are.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe.llm import storage, textops

PART_ROWS = 1 << 16
OWNER_ROWS = 1 << 16
RELAY_ROWS = 1 << 20
STEP = 8
#: Marks of rows that one job hands to its tasks; files are read in as many blocks as this asks for.
MARK_BYTES = 32 << 20
SALTS = 16
MESSAGE = "part binary, bucket long, code binary"
ANSWER = "part binary, bucket long, bits binary"


def golomb(values: np.ndarray, width: int) -> bytes:
    """Sorted distinct values below 2^``width``: quotients of the differences in unary, remainders in binary."""
    n = len(values)
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, width - n.bit_length())
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    places = np.arange(k - 1, -1, -1, dtype=np.uint64)
    binary = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8)
    head = np.packbits(unary).tobytes()
    return struct.pack("<IBI", n, k, len(head)) + head + np.packbits(binary).tobytes()


def golomb_values(code: bytes) -> np.ndarray:
    n, k, size = struct.unpack_from("<IBI", code)
    head = np.unpackbits(np.frombuffer(code, np.uint8, size, 9))
    gaps = (np.diff(np.flatnonzero(head == 0)[:n], prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        rest = np.unpackbits(np.frombuffer(code, np.uint8, offset=9 + size))[: n * k].reshape(n, k)
        places = np.arange(k - 1, -1, -1, dtype=np.uint64)
        gaps += (rest.astype(np.uint64) << places).sum(1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _cuts(values: np.ndarray, done: int, step: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of sorted values by the ``step`` bits that follow the first ``done``, ascending."""
    high = (values >> np.uint64(64 - done - step)).astype(np.int64) & ((1 << step) - 1)
    edges = np.flatnonzero(np.diff(high, prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(high[a]), a, b


def _messages(part: bytes, base: int, values: np.ndarray, done: int, step: int) -> Iterator[tuple[bytes, int, bytes]]:
    """What a sender of sorted distinct ``values``, whose first ``done`` bits are ``base``, has to say."""
    width = 64 - done - step
    low = values & np.uint64((1 << width) - 1)
    for number, a, b in _cuts(values, done, step):
        yield part, (base << step) | number, golomb(low[a:b], width)


def _marks(values: np.ndarray, done: int, step: int, answers: dict[int, bytes]) -> np.ndarray:
    """The answers to a sender's messages as one mark a value; ``answers`` by the last ``step`` bits of the bucket."""
    marks = np.zeros(len(values), bool)
    for number, a, b in _cuts(values, done, step):
        marks[a:b] = np.unpackbits(np.frombuffer(answers[number], np.uint8), count=b - a)
    return marks


def _columns(table: pa.Table, *names: str) -> list[tuple]:
    return sorted(zip(*(table[n].to_pylist() for n in names)))


def _table(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(fields)})


def _message_table(rows: list[tuple]) -> pa.Table:
    return _table(rows, ("part", pa.binary()), ("bucket", pa.int64()), ("code", pa.binary()))


def _answers(messages: list[tuple], marks: np.ndarray, ends: np.ndarray) -> pa.Table:
    """``marks`` of the messages' values, one message after the other, cut at ``ends``."""
    starts = [0, *ends[:-1].tolist()]
    rows = [(m[0], m[1], np.packbits(marks[a:b]).tobytes()) for m, a, b in zip(messages, starts, ends.tolist())]
    return _table(rows, ("part", pa.binary()), ("bucket", pa.int64()), ("bits", pa.binary()))


def _merged(messages: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of all messages, the place of each message's values among them, counts, message ends."""
    lists = [golomb_values(code) for _, _, code in messages]
    values, places, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    return values, places, counts, np.cumsum([len(x) for x in lists])


def _owner(table: pa.Table) -> pa.Table:
    messages = _columns(table, "part", "bucket", "code")
    _, places, counts, ends = _merged(messages)
    return _answers(messages, counts[places] > 1, ends)


def answered(messages: DataFrame, rows: int, done: int, steps: list[int]) -> DataFrame:
    """(part, bucket, bits): for each message, which of its values another message of the bucket holds too."""
    if not steps:
        return messages.groupBy("bucket").applyInArrow(_owner, ANSWER)
    relays, step = max(1, -(-rows // (RELAY_ROWS << done))), steps[0]
    name = F.concat_ws(":", "bucket", F.pmod(F.xxhash64("part"), F.lit(relays))).cast("binary")
    gathered = messages.withColumn("relay", name)

    def deal(table: pa.Table) -> pa.Table:
        values, _, _, _ = _merged(_columns(table, "part", "bucket", "code"))
        # The values lack their first bits, but the next ones stand where a sender's do.
        return _message_table(list(_messages(table["relay"][0].as_py(), table["bucket"][0].as_py(), values, done, step)))

    def give_back(own: pa.Table, found: pa.Table) -> pa.Table:
        messages = _columns(own, "part", "bucket", "code")
        values, places, counts, ends = _merged(messages)
        answers = {bucket & ((1 << step) - 1): bits for bucket, bits in _columns(found, "bucket", "bits")}
        marks = _marks(values, done, step, answers)
        return _answers(messages, ((counts > 1) | marks)[places], ends)

    sent = storage.staged(gathered.groupBy("relay").applyInArrow(deal, MESSAGE), "relayed")
    found = answered(sent, rows, done + step, steps[1:])
    return gathered.groupBy("relay").cogroup(found.withColumnRenamed("part", "relay").groupBy("relay")).applyInArrow(give_back, ANSWER)


def _digests(texts: pa.Array) -> tuple[list[bytes], memoryview, np.ndarray]:
    """SHA-256 of each text in lower case, those texts as one buffer, and their offsets."""
    raw, at = textops.text_buffer(texts)
    lower = memoryview(textops.lower_table()[raw].tobytes())
    return [hashlib.sha256(lower[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], lower, at


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Stretches of one file's consecutive rows."""
    rows = np.asarray(batch.column("row")).astype(np.int64)
    files = batch.column("file").dictionary_encode()
    codes = np.asarray(files.indices)
    edges = np.flatnonzero((np.diff(rows) != 1) | (np.diff(codes) != 0)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)]):
        if b > a:
            yield files.dictionary[int(codes[a])].as_py(), batch.slice(a, b - a)


def parts(placed: DataFrame, bits: int) -> DataFrame:
    """(part, file, first, n, prints): fingerprints of at most ``PART_ROWS`` consecutive rows, in row order."""
    keep = np.uint64(((1 << bits) - 1) << (64 - bits))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, first, prints = None, 0, []

        def row():
            values = np.frombuffer(b"".join(prints), ">u8").astype(np.uint64) & keep
            part = hashlib.md5(f"{first}:{file}".encode()).digest()
            columns = [part, file, first, len(values), zlib.compress(values.tobytes(), 1)]
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], ["part", "file", "first", "n", "prints"])

        for batch in batches:
            for name, run in _runs(batch):
                start = run.column("row")[0].as_py()
                for piece in textops.slices(run):
                    if prints and (name != file or start != first + len(prints) or len(prints) >= PART_ROWS):
                        yield row()
                        prints = []
                    if not prints:
                        file, first = name, start
                    prints += [d[:8] for d in _digests(piece.column("text"))[0]]
                    start += piece.num_rows
        if prints:
            yield row()

    return placed.select("file", "row", "text").mapInArrow(send, "part binary, file string, first long, n long, prints binary")


def _prints(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.uint64)


def marks(sent: DataFrame, rows: int, owner_rows: int = OWNER_ROWS, step: int = STEP) -> DataFrame:
    """(file, first, n, bits): one bit a row of each part, set where another row has the same fingerprint."""
    width = max(1, (-(-rows // owner_rows) - 1).bit_length())
    steps = [min(step, width - k) for k in range(0, width, step)]
    first_step = steps[0]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("prints").to_pylist()):
                yield from _message_table(list(_messages(part, 0, np.unique(_prints(blob)), 0, first_step))).to_batches()

    def receive(own: pa.Table, found: pa.Table) -> pa.Table:
        answers = dict(_columns(found, "bucket", "bits"))
        out = []
        for file, first, n, blob in _columns(own, "file", "first", "n", "prints"):
            values, places, counts = np.unique(_prints(blob), return_inverse=True, return_counts=True)
            repeated = ((counts > 1) | _marks(values, 0, first_step, answers))[places]
            out.append((file, first, n, zlib.compress(np.packbits(repeated).tobytes())))
        return _table(out, ("file", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()))

    messages = storage.staged(sent.select("part", "prints").mapInArrow(send, MESSAGE), "fingerprints")
    found = answered(messages, rows, first_step, steps[1:])
    return sent.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(receive, "file string, first long, n long, bits binary")


def marked(placed: DataFrame, key: str, found: list[tuple]) -> DataFrame:
    """(key, row_name, text_sha256, norm): ``norm`` holds the lower-case text of marked rows and is null for the others."""
    by_file: dict[str, list[tuple]] = {}
    for file, first, n, bits in sorted(tuple(r) for r in found):
        by_file.setdefault(file, []).append((first, n, bits))
    shared = placed.sparkSession.sparkContext.broadcast(by_file)  # at most about MARK_BYTES
    schema = T.StructType([
        placed.schema[key], T.StructField("row_name", T.LongType()), T.StructField("text_sha256", T.StringType()),
        T.StructField("norm", T.BinaryType()),
    ])

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, run in _runs(batch):
                spans = shared.value[file]
                rows = np.asarray(run.column("row")).astype(np.int64)
                repeated = np.zeros(len(rows), bool)
                k = int(np.searchsorted([s[0] for s in spans], rows[0], side="right")) - 1
                while k < len(spans) and spans[k][0] <= rows[-1]:
                    first, n, bits = spans[k]
                    here = (rows >= first) & (rows < first + n)
                    repeated[here] = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[rows[here] - first]
                    k += 1
                done = 0
                for piece in textops.slices(run):
                    digests, lower, at = _digests(piece.column("text"))
                    on = repeated[done : done + piece.num_rows].tolist()
                    norm = [bytes(lower[a:b]) if x else None for a, b, x in zip(at[:-1].tolist(), at[1:].tolist(), on)]
                    done += piece.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(key), piece.column("row_name"), pa.array([d.hex() for d in digests]), pa.array(norm, pa.binary())],
                        schema.names,
                    )

    return placed.select("file", "row", key, "row_name", "text").mapInArrow(pass_on, schema)


def exact_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", stored: bool = False, bits: int = 64, **sizes: int
) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256.

    ``stored`` says that ``docs`` is a plain reading of Parquet files, whose rows
    then have lasting places; otherwise key and text are written first. ``bits``
    is the length of a fingerprint.
    """
    spark = docs.sparkSession
    files = docs if stored else storage.staged(docs.select(key, text), "texts")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    placed = files.select(F.col(key), F.col(text).alias("text"), *place).withColumn("row_name", F.xxhash64("file", "row"))
    sent = storage.staged(parts(placed, bits), "parts")
    rows = sent.agg(F.sum("n")).first()[0] or 0
    found = storage.staged(marks(sent, rows, **sizes), "marks")
    total = found.agg(F.sum(F.length("bits") + F.length("file"))).first()[0] or 0
    blocks, path = -(-total // MARK_BYTES) or 1, f"{storage.shared_folder(spark)}/marked-{uuid.uuid4().hex}"
    block = F.pmod(F.xxhash64("file"), F.lit(blocks))
    for k in range(blocks):  # one, unless the marks are too many for a broadcast; a file is read in one block only
        here = marked(placed.filter(block == k), key, found.filter(block == k).collect())
        here.write.mode("append").option("compression", "zstd").parquet(path)
        schema = here.schema
    all_rows = spark.read.schema(schema).parquet(path)

    # Equal bytes meet: first within a task and a salt, then over all.
    count = F.sum("n").alias("n"), F.max("keep").alias("keep"), F.coalesce(F.max_by("row_name", "keep"), F.min("row_name")).alias("row_name")
    suspects = all_rows.filter("norm IS NOT NULL")
    single = suspects.select("text_sha256", "norm", F.pmod("row_name", F.lit(SALTS)).alias("salt"), F.lit(1).cast("long").alias("n"), F.col(key).alias("keep"), "row_name")
    groups = single.groupBy("text_sha256", "norm", "salt").agg(*count).groupBy("text_sha256", "norm").agg(*count)
    groups = groups.select(F.col("text_sha256").alias("of"), F.col("n").alias("group_size"), F.col("keep").alias("keep_id"), F.col("row_name").alias("stays"))
    joined = suspects.drop("norm").join(groups, F.col("text_sha256") == F.col("of"))
    alone = all_rows.filter("norm IS NULL").withColumns({"keep_id": F.col(key), "group_size": F.lit(1).cast("long"), "stays": F.col("row_name")})
    return joined.drop("of").unionByName(alone.drop("norm")).select(
        key, "keep_id", "group_size", (F.col("row_name") == F.col("stays")).alias("kept"), "text_sha256"
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, text_sha256): the rows that stay."""
    return exact_copies(docs, key, text, **options).filter("kept").select(key, "text_sha256")


ORACLE_SQL = """
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
