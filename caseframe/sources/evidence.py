"""Inventories, file contents, raw blocks and reference hash tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from caseframe import schemas

# Table variants of a reference hash export, best first.
REFERENCE_VARIANTS = ("FILE", "METADATA")


def read_entries(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw inventory entries in a fixed schema (no inference)."""
    return spark.read.format(fmt).schema(schemas.ENTRIES).load(path)


def read_tree(
    spark: SparkSession, root: str, glob: str | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Files of an exported tree: path, modified, size, content.

    Content of a file above ``max_bytes`` is NULL; its row stays.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    base = files.select(
        F.regexp_replace("path", "^file:(?://)?", "").alias("path"),
        F.col("modificationTime").alias("modified"),
        F.col("length").alias("size"),
        "content",
    )
    if max_bytes is None:
        return base
    # The reader skips the bytes only where the filter is on its own column.
    small = base.where(F.col("size") <= max_bytes)
    large = base.where(F.col("size") > max_bytes).withColumn("content", F.lit(None).cast("binary"))
    return small.unionByName(large)


#: Bytes of an image that one task reads, and blocks of one batch of rows.
SPLIT_BYTES = 128 << 20
BATCH_BLOCKS = 1024
#: Disk images are whole sectors; records of whole sectors need no byte ranges.
SECTOR = 512
RECORD_BYTES = 1 << 20


@dataclass(frozen=True)
class Image:
    """A raw image, or a volume inside it that begins at ``volume_offset``."""

    path: str
    volume_id: int = 0
    volume_offset: int = 0


@dataclass
class ByteRange(InputPartition):
    image: Image
    first: int  # block number
    last: int  # exclusive


class RawBlocksReader(DataSourceReader):
    """Blocks of raw images by byte range; the last one may be short."""

    def __init__(self, options):
        self.images = [Image(*fields) for fields in json.loads(options["images"])]
        self.block_size = int(options["block_size"])

    def _open(self, image: Image):
        from pyarrow import fs

        path = re.sub("^s3[an]://", "s3://", image.path)  # the same store under the name that this library knows
        system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        return system.open_input_file(place)

    def partitions(self) -> list[ByteRange]:
        step, out = max(1, SPLIT_BYTES // self.block_size), []
        for image in self.images:
            with self._open(image) as file:
                blocks = -(-max(file.size() - image.volume_offset, 0) // self.block_size)
            out += [ByteRange(image, k, min(k + step, blocks)) for k in range(0, blocks, step)]
        return out or [ByteRange(Image(""), 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        image, size = partition.image, self.block_size
        with self._open(image) as file:
            for k in range(partition.first, partition.last, BATCH_BLOCKS):
                n = min(BATCH_BLOCKS, partition.last - k)
                data = file.read_at(n * size, image.volume_offset + k * size)
                cut = [data[i : i + size] for i in range(0, len(data), size)]
                place = [pa.array([v] * len(cut), pa.int64()) for v in (image.volume_id, image.volume_offset)]
                numbers = pa.array(range(k, k + len(cut)), pa.int64())
                yield pa.RecordBatch.from_arrays([*place, numbers, pa.array(cut, pa.binary())], ["volume_id", "volume_offset", "block_index", "data"])


class RawBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_blocks"

    def schema(self) -> str:
        return "volume_id long, volume_offset long, block_index long, data binary"

    def reader(self, schema) -> RawBlocksReader:
        return RawBlocksReader(self.options)


def _size_of(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getLen()


def record_length(size: int, block_size: int) -> int | None:
    """Bytes of the records that cover an image of whole sectors without a rest, as long as they may be."""
    if not size or size % SECTOR:
        return None
    sectors = size // SECTOR
    most = max(block_size, RECORD_BYTES) // SECTOR
    return SECTOR * max(d for d in range(1, most + 1) if sectors % d == 0)


def _blocks_by_records(spark: SparkSession, image: Image, block_size: int, length: int) -> DataFrame:
    """Blocks cut from fixed-length records, which Spark's own file systems read in splits.

    A block that lies in one record is cut from it; one that lies in several is put together.
    """
    records = spark.sparkContext.newAPIHadoopFile(
        image.path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.BytesWritable", conf={"fixedlengthinputformat.record.length": str(length)},
    )
    rows = spark.createDataFrame(records.map(lambda r: (r[0], bytes(r[1]))), "at long, record binary")
    start = F.greatest(F.col("at") - image.volume_offset, F.lit(0).cast("long"))  # in the volume
    end = F.col("at") + length - image.volume_offset
    numbers = F.sequence(F.expr(f"_start div {block_size}"), F.expr(f"(_end - 1) div {block_size}"))
    placed = rows.withColumns({"_start": start, "_end": end}).where("_end > 0").select("*", F.explode(numbers).alias("block_index"))
    lo = F.greatest(F.col("_start"), F.col("block_index") * block_size)
    hi = F.least(F.col("_end"), (F.col("block_index") + 1) * block_size)
    cut = F.substring(F.col("record"), (lo + image.volume_offset - F.col("at") + 1).cast("int"), (hi - lo).cast("int"))
    pieces = placed.select("block_index", lo.alias("lo"), cut.alias("data"))
    if length % block_size or image.volume_offset % block_size:
        parts = F.array_sort(F.collect_list(F.struct("lo", F.decode("data", "ISO-8859-1").alias("t"))))
        text = F.array_join(F.transform(parts, lambda p: p["t"]), "")
        pieces = pieces.groupBy("block_index").agg(F.encode(text, "ISO-8859-1").alias("data"))
    return pieces.select(
        F.lit(image.volume_id).cast("long").alias("volume_id"), F.lit(image.volume_offset).cast("long").alias("volume_offset"),
        "block_index", "data",
    )


def read_images(spark: SparkSession, images: list[Image], block_size: int) -> DataFrame:
    """Blocks of raw images, each from its ``volume_offset`` on: volume_id, volume_offset, block_index, data.

    Images are read in byte ranges; a block that an image cuts short has what is there.
    """
    spark.dataSource.register(RawBlocks)
    named = json.dumps([[i.path, i.volume_id, i.volume_offset] for i in images])
    return spark.read.format("raw_blocks").option("block_size", block_size).option("images", named).load()


def read_blocks(
    spark: SparkSession, path: str, block_size: int, volume_id: int = 0, volume_offset: int = 0
) -> DataFrame:
    """Blocks of one raw image from ``volume_offset`` on: volume_id, volume_offset, block_index, data.

    An image of whole sectors, as disk images are, is read as fixed-length
    records through Spark's own file systems, so from any store that Spark
    reads. Another one is read in byte ranges by the Python workers, from local
    files and the stores that pyarrow knows.
    """
    image = Image(path, volume_id, volume_offset)
    length = record_length(_size_of(spark, path), block_size)
    return _blocks_by_records(spark, image, block_size, length) if length else read_images(spark, [image], block_size)


def pick_variant(available: list[str]) -> str:
    """Table variant of a reference export, from the fixed list only."""
    for name in REFERENCE_VARIANTS:
        if name in available:
            return name
    raise ValueError(f"no reference hash table among {sorted(available)}: expected {REFERENCE_VARIANTS}")


def read_reference(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """Reference hashes from an export with one sub-folder per table variant."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    base = hadoop.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    present = [n for n in REFERENCE_VARIANTS if fs.exists(hadoop.Path(base, n))]
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.load(f"{root}/{pick_variant(present)}")


def read_reference_jdbc(spark: SparkSession, url: str, available: list[str], **options: str) -> DataFrame:
    """Reference hashes over JDBC; partition options make the read parallel."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=pick_variant(available), **options)
        .load()
    )
