"""Contents in pieces: put together from blocks, and digested without being one value.

A piece is a row (object columns, base, data). Nothing here holds a whole
content: pieces of an object are read in order, with one running state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caseframe.functions.hashes import ALGORITHMS

INODE = ["volume_id", "meta_addr"]


class Running:
    """Digests of the bytes read so far; reading stops at the first hole."""

    def __init__(self) -> None:
        self.digests = [hashlib.new(a) for a in ALGORITHMS]
        self.read = 0
        self.ended = False

    def add(self, base: int, data: memoryview) -> None:
        if self.ended or base > self.read:
            self.ended = True
            return
        fresh = data[self.read - base :]  # pieces may overlap
        for digest in self.digests:
            digest.update(fresh)
        self.read += len(fresh)


def chunk_digests(chunks: DataFrame, sizes: DataFrame, keys: list[str], max_hash_size: int | None = None) -> DataFrame:
    """keys, size, read_length, md5, sha1, sha256, hash_skipped of every object in ``sizes`` (keys, size).

    ``chunks``: keys, base, data. Pieces are sorted by a shuffle and folded in
    order, so an object of any length costs one state. What cannot be read up to
    its size is a ``short_read`` and has no digests; an object above
    ``max_hash_size`` is not read. Keys may be null.
    """
    schema = T.StructType([
        *[chunks.schema[k] for k in keys], T.StructField("read_length", T.LongType()),
        *[T.StructField(a, T.StringType()) for a in ALGORITHMS],
    ])
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            names = zip(*(batch.column(k).to_pylist() for k in keys))
            data = batch.column("data")
            for i, (name, base) in enumerate(zip(names, batch.column("base").to_pylist())):
                if state is None or name != now:
                    if state is not None:
                        out.append((*now, state.read, *(d.hexdigest() for d in state.digests)))
                    now, state = name, Running()
                state.add(base, memoryview(data[i].as_buffer() or b""))
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
                out = []
        if state is not None:
            out.append((*now, state.read, *(d.hexdigest() for d in state.digests)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    too_big = F.lit(False) if max_hash_size is None else F.col("size") > max_hash_size
    wanted = chunks.where(F.octet_length("data") > 0).select(*keys, "base", "data")
    if max_hash_size is not None:
        small = sizes.where(~F.coalesce(too_big, F.lit(False))).select(*[F.col(k).alias(f"_{k}") for k in keys])
        wanted = wanted.join(small, _same(keys), "left_semi")
    read = wanted.repartition(*keys).sortWithinPartitions(*keys, "base").mapInArrow(fold, schema)
    joined = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], "size").join(read, _same(keys), "left")
    length = F.coalesce("read_length", F.lit(0).cast("long"))
    skipped = F.when(too_big, "exceeds_max_hash_size").when(length != F.col("size"), "short_read")
    empty = {a: hashlib.new(a).hexdigest() for a in ALGORITHMS}
    return joined.select(
        *[F.col(f"_{k}").alias(k) for k in keys], "size", length.alias("read_length"),
        *[F.when(skipped.isNull(), F.coalesce(F.col(a), F.lit(empty[a]))).alias(a) for a in ALGORITHMS],
        skipped.alias("hash_skipped"),
    )


def _same(keys: list[str]) -> Column:
    both = F.lit(True)
    for k in keys:
        both = both & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return both


def recovered_chunks(inodes: DataFrame, blocks: DataFrame, block_size: int) -> DataFrame:
    """volume_id, meta_addr, base, data: the contents of deleted inodes as pieces.

    ``inodes``: volume_id, meta_addr, size, runs (in the order of the file; a run
    without a start is a hole and reads as zeros), and optionally ``resident``,
    data in the record itself, which comes first and then stands alone.
    ``blocks``: volume_id, block_index, data. A run is laid out to its blocks and
    these to their places in the file, up to ``size``; a block joins the places
    that want it, whatever the number of inodes that share it. Blocks that
    cannot be read leave a gap.
    """
    resident = F.col("resident") if "resident" in inodes.columns else F.lit(None).cast("binary")
    rows = inodes.select(*INODE, "size", "runs", resident.alias("resident"))
    held = rows.where("resident is not null and size > 0").select(
        *INODE, F.lit(0).cast("long").alias("base"), F.expr("substring(resident, 1, cast(least(size, 2147483647) as int))").alias("data")
    )
    before = F.transform(
        F.sequence(F.lit(1), F.size("runs")),
        lambda i: F.aggregate(F.slice("runs", 1, i - 1), F.lit(0).cast("long"), lambda total, r: total + F.greatest(r["len"], F.lit(0))),
    )
    laid = (
        rows.where("resident is null and size > 0 and size(runs) > 0")
        .select(*INODE, "size", F.explode(F.arrays_zip("runs", before.alias("at"))).alias("r"))
        .select(*INODE, "size", "r.runs.start", F.col("r.runs.len").alias("len"), F.col("r.at").alias("at"))
    )
    # Blocks of a run that the size reaches.
    wanted = F.least(F.col("len"), F.ceil(F.col("size") / block_size).cast("long") - F.col("at"))
    placed = laid.withColumn("_n", wanted).where("_n > 0").select(
        *INODE, "size", "start", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("i")
    )
    base = (F.col("at") + F.col("i")) * block_size
    left = F.least(F.col("size") - F.col("base"), F.lit(block_size)).cast("int")
    whole = placed.select(*INODE, "size", base.alias("base"), (F.col("start") + F.col("i")).alias("block_index"))
    zeros = whole.where("block_index is null").select(*INODE, "base", F.lpad(F.lit(b""), left, F.lit(b"\0")).alias("data"))
    read = whole.where("block_index is not null").join(
        blocks.select("volume_id", "block_index", F.col("data").alias("_data")), ["volume_id", "block_index"]
    )
    found = read.select(*INODE, "base", F.substring(F.col("_data"), F.lit(1), left).alias("data"))
    return held.unionByName(zeros).unionByName(found)


def readable(chunks: DataFrame, digests: DataFrame, keys: list[str]) -> DataFrame:
    """The pieces in front of the first gap of each object, as ``chunk_digests`` has found it."""
    ends = digests.select(*[F.col(k).alias(f"_{k}") for k in keys], "read_length")
    joined = chunks.join(ends, _same(keys)).where(F.col("base") < F.col("read_length"))
    return joined.select(*chunks.columns)
