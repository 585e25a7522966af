"""Log lines, hash lists and indicator lists from text.

Lines have a file-wide order key ``(line_ord, line_sub)``; it grows with the
position in the file but is not dense.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Everything that ends a line in decoded text, CRLF as one.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
_EXTRA_BREAK = "[\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"

# Bytes taken in and given out at a time while inflating.
INFLATE_STEP = 1 << 20


def decoded(content: Column) -> Column:
    """UTF-8 text with U+FFFD for malformed bytes."""
    return F.make_valid_utf8(content.cast("string"))


def lines_of(df: DataFrame, text: Column) -> DataFrame:
    """One row per line of a text value, numbered from 0; a final break opens no line."""
    pieces = F.col("_pieces")
    closed = F.element_at(pieces, -1) == ""
    return (
        df.withColumn("_pieces", F.split(text, LINE_BREAK, -1))
        .select(
            *df.columns,
            F.posexplode(
                F.when(closed, F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
            ).alias("_pos", "line"),
        )
        .select(
            *df.columns,
            F.col("_pos").cast("long").alias("line_ord"),
            F.lit(0).alias("line_sub"),
            "line",
        )
    )


def read_log_lines(spark: SparkSession, paths: str | list[str], volume_id: int = 0) -> DataFrame:
    """Lines of plain text files, read in splits.

    A line is keyed by twice its split start plus its row number inside the
    task: a split is never longer than the rows before it in the task can
    count, so keys ascend along the file without numbering it globally.
    """
    row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    raw = (
        spark.read.option("recursiveFileLookup", "true")
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("path"),
            (F.col("_metadata.file_block_start") * 2 + row_in_task).alias("line_ord"),
            F.make_valid_utf8("value").alias("value"),
        )
    )
    pieces = F.when(F.col("value").rlike(_EXTRA_BREAK), F.split("value", _EXTRA_BREAK, -1)).otherwise(
        F.array("value")
    )
    return raw.select(
        F.lit(volume_id).cast("long").alias("volume_id"),
        F.regexp_replace("path", "^file:(?://)?", "").alias("path"),
        "line_ord",
        F.posexplode(pieces).alias("line_sub", "line"),
    )


class DamagedMember(ValueError):
    """A gzip member that ends early or does not decode."""


def inflated(data: bytes) -> Iterator[bytes]:
    """Inflated gzip data in steps; streams may follow each other, with NUL padding between and behind."""
    rest, stream = memoryview(data), None
    started = False
    while True:
        if stream is None or stream.eof:
            left = bytes(stream.unused_data) if stream is not None else b""
            rest = memoryview((left + bytes(rest)).lstrip(b"\0") if started else left + bytes(rest))
            if not rest:
                if not started:
                    raise DamagedMember("no data")
                return
            stream, started = zlib.decompressobj(wbits=31), True
            pending = b""
        take = pending or bytes(rest[:INFLATE_STEP])
        if not pending:
            rest = rest[len(take) :]
        if not take:
            raise DamagedMember("the data ends inside a stream")
        try:
            out = stream.decompress(take, INFLATE_STEP)
        except zlib.error as exc:
            raise DamagedMember(str(exc)) from exc
        pending = stream.unconsumed_tail
        if out:
            yield out


def damage(data: bytes | None) -> str | None:
    """Why a gzip member cannot be read; NULL if it can."""
    try:
        for _ in inflated(data or b""):
            pass
    except DamagedMember as exc:
        return str(exc)
    return None


def inflate_members(members: DataFrame) -> DataFrame:
    """volume_id, path, piece, content: gzip members inflated in pieces.

    A member is tested to its end before its first piece is made: a damaged one
    gives no rows here and one row of ``damaged_members``. Only one step of one
    member is held, whatever it inflates to and wherever its lines end.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for volume_id, path, data in zip(pdf["volume_id"], pdf["path"], pdf["content"]):
                if damage(data) is None:
                    for n, piece in enumerate(inflated(data)):
                        yield pd.DataFrame({"volume_id": [volume_id], "path": [path], "piece": [n], "content": [piece]})

    return members.select("volume_id", "path", "content").mapInPandas(run, "volume_id long, path string, piece long, content binary")


def damaged_members(members: DataFrame) -> DataFrame:
    """The rows of gzip members that cannot be read, with ``reason`` in place of the content."""

    @F.pandas_udf("string")
    def reason(content: pd.Series) -> pd.Series:
        return content.map(damage)

    packed = members.where("is_gz and content is not null and octet_length(content) > 0")
    return packed.withColumn("reason", reason("content")).where("reason is not null").drop("content")


#: Bytes of a piece of a long plain member, and pieces that one window runs over.
PIECE_BYTES = 1 << 20
SEGMENT_PIECES = 4096


def cut_pieces(members: DataFrame, keys: list[str], size: int = PIECE_BYTES) -> DataFrame:
    """keys, piece, content: contents cut every ``size`` bytes; a content within one piece stays as it is."""
    count = F.greatest(F.ceil(F.octet_length("content") / size), F.lit(1)).cast("int")
    numbered = members.select(*keys, "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("_no"))
    return numbered.select(
        *keys, F.col("_no").cast("long").alias("piece"),
        F.substring(F.col("content"), F.col("_no") * size + 1, F.lit(size)).alias("content"),
    )


def lines_of_pieces(pieces: DataFrame, keys: list[str], segment: int = SEGMENT_PIECES) -> DataFrame:
    """Lines of contents in pieces (keys, piece, content): keys, line_ord, line_sub, line.

    The same lines as those of the whole contents. Inside a piece, whole lines
    lie between its first and its last line feed; what is before belongs to the
    line that an earlier piece has begun, what is behind begins one. Only these
    ends are put together, so no value is longer than a piece and a line. Keys
    are not null; pieces count from 0 without gaps.
    """
    raw = F.col("content").cast("string")  # cut at single bytes only
    size, head, tail = (F.octet_length(x) for x in (F.col("content"), F.substring_index(raw, "\n", 1), F.substring_index(raw, "\n", -1)))
    marked = pieces.select(*keys, "piece", "content", size.alias("_n"), head.alias("_head"), tail.alias("_tail"))
    broken = F.col("_head") < F.col("_n")
    part = lambda a, n: F.substring(F.col("content"), a.cast("int"), n.cast("int"))
    inner = marked.where(broken & (F.col("_head") + F.col("_tail") + 1 < F.col("_n"))).select(
        *keys, ((F.col("piece") * 2 + 1) * (1 << 31)).alias("_ord"),
        part(F.col("_head") + 2, F.col("_n") - F.col("_head") - F.col("_tail") - 1).alias("content"),
    )

    # The line that a piece's beginning belongs to was begun behind the last line feed before it.
    seg = F.expr(f"piece div {int(segment)}")
    last = F.max(F.when(broken, F.col("piece")))
    carried = marked.groupBy(*keys, seg.alias("_seg")).agg(last.alias("_last"))
    before = W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    carried = carried.select(*keys, "_seg", F.max("_last").over(before).alias("_carry"))
    inside = W.partitionBy(*keys, "_seg").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    ends = marked.select(
        *keys, "piece", seg.alias("_seg"), broken.alias("_broken"),
        part(F.lit(1), F.least(F.col("_head") + 1, F.col("_n"))).alias("_first"), F.when(broken, part(F.col("_n") - F.col("_tail") + 1, F.col("_tail"))).alias("_rest"),
    )
    begun = F.max(F.when(F.col("_broken"), F.col("piece"))).over(inside)
    placed = ends.withColumn("_begun", begun).join(carried, [*keys, "_seg"])
    since = F.coalesce("_begun", "_carry", F.lit(-1))
    fragments = placed.select(*keys, since.alias("_since"), "piece", F.col("_first").alias("_bytes")).unionByName(
        placed.where("_broken").select(*keys, F.col("piece").alias("_since"), "piece", F.col("_rest").alias("_bytes"))
    )
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("piece", F.decode("_bytes", "ISO-8859-1").alias("t")))), lambda f: f["t"]), ""
    )
    stitched = fragments.where(F.octet_length("_bytes") > 0).groupBy(*keys, "_since").agg(F.encode(text, "ISO-8859-1").alias("content"))
    joined = stitched.select(*keys, ((F.col("_since") + 1) * (1 << 32)).alias("_ord"), "content")

    both = inner.unionByName(joined).withColumn("_text", decoded(F.col("content")))
    lines = lines_of(both.select(*keys, "_ord", "_text"), F.col("_text"))
    return lines.select(*keys, (F.col("_ord") + F.col("line_ord")).alias("line_ord"), "line_sub", "line")


def lines_of_members(members: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Lines of log members given their content.

    ``members``: volume_id, path, is_gz, content. Only gzip members pass
    through Python. A plain member above ``piece_bytes`` is read in pieces.
    """
    keys = ["volume_id", "path"]
    narrow = members.select(*keys, "is_gz", "content").where("content is not null")
    long = ~F.col("is_gz") & (F.octet_length("content") > piece_bytes)
    plain = narrow.where(~F.col("is_gz") & ~long).withColumn("_text", decoded(F.col("content")))
    whole = lines_of(plain.select(*keys, "_text"), F.col("_text")).drop("_text")
    pieces = cut_pieces(narrow.where(long), keys, piece_bytes).unionByName(inflate_members(narrow.where("is_gz")))
    return whole.unionByName(lines_of_pieces(pieces, keys).select(*whole.columns))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list file in column ``value``; undecodable text is an error."""
    raw = spark.read.text(path)
    return raw.select(F.validate_utf8("value").alias("value"))


def ioc_terms(lines: DataFrame, order: str = "line_no", line_col: str = "value") -> DataFrame:
    """Distinct indicators with the order value of their first line."""
    term = F.regexp_replace(F.col(line_col), r"(?U)^\s+|\s+$", "")
    return (
        lines.select(term.alias("term"), F.col(order).alias("first_line"))
        .where((F.col("term") != "") & ~F.col("term").startswith("#"))
        .groupBy("term")
        .agg(F.min("first_line").alias("first_line"))
    )
