"""Raw inventory entries to normalized file rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.functions import attributes, hashes, labels, signatures, times

MACB = ("mtime", "atime", "ctime", "crtime")


def with_allocation(entries: DataFrame) -> DataFrame:
    """Allocated only when both the name and the inode are."""
    return entries.withColumn(
        "allocated",
        F.coalesce(F.col("name_alloc"), F.lit(False)) & F.coalesce(F.col("meta_alloc"), F.lit(False)),
    )


def with_labels(entries: DataFrame) -> DataFrame:
    return (
        entries.withColumn("fs_type", labels.fs_type_label(F.col("fs_type_code")))
        .withColumn(
            "meta_type", labels.meta_type_label(F.col("meta_type_code"), F.col("name_type_code"))
        )
        .withColumn(
            "timestamp_source",
            F.when(F.col("meta_addr").isNotNull(), labels.timestamp_source(F.col("fs_type"))),
        )
    )


def with_macb(entries: DataFrame, zone: str = "UTC") -> DataFrame:
    """Four UTC instants; entries without an inode have none."""
    fat = labels.is_fat(F.col("fs_type_code"))
    out = entries
    for name in MACB:
        stamp = times.macb_utc(F.col(name), F.col(f"{name}_nano"), fat, zone)
        out = out.withColumn(f"{name}_utc", F.when(F.col("meta_addr").isNotNull(), stamp))
    return out


def hash_skip_reason(max_hash_size: int | None) -> Column:
    """Why an allocated regular entry has no digest; NULL when it has one.

    Content that could not be read is NULL. A partial digest is never kept.
    """
    eligible = (F.col("meta_type") == "reg") & F.col("allocated")
    too_big = F.lit(False) if max_hash_size is None else F.col("size") > max_hash_size
    return F.when(
        eligible,
        F.when(F.col("size") == 0, F.lit(None).cast("string"))
        .when(too_big, "exceeds_max_hash_size")
        .when(F.col("content").isNull(), "read_error")
        .when(F.octet_length("content") != F.col("size"), "short_read"),
    )


def with_content_fields(
    entries: DataFrame,
    max_hash_size: int | None = None,
    typer: Callable[[Column], Column] = signatures.file_type,
) -> DataFrame:
    """Digests, type and skip reason. ``typer`` may be a ``pandas_udf`` of the user."""
    regular = F.col("meta_type") == "reg"
    out = entries.withColumn("hash_skipped", hash_skip_reason(max_hash_size))
    hashable = regular & F.col("allocated") & F.col("hash_skipped").isNull()
    source = F.when(F.col("size") == 0, F.lit(b"")).otherwise(F.col("content"))
    for algo in hashes.ALGORITHMS:
        out = out.withColumn(algo, F.when(hashable, hashes.digest(source, algo)))
    sniffed = F.when(F.col("size") == 0, signatures.EMPTY_TYPE).otherwise(typer(F.col("content")))
    return out.withColumn(
        "file_type", F.when(regular, sniffed).otherwise(labels.structural_type(F.col("meta_type")))
    ).withColumn(
        "file_type_provenance",
        F.when(
            regular & F.col("file_type").isNotNull() & ~F.col("allocated"),
            "unallocated-blocks-may-be-reused",
        ),
    )


def normalize(
    entries: DataFrame,
    zone: str = "UTC",
    max_hash_size: int | None = None,
    typer: Callable[[Column], Column] = signatures.file_type,
) -> DataFrame:
    """Entries to the ``files`` table."""
    rows = with_content_fields(
        with_macb(with_labels(with_allocation(entries)), zone), max_hash_size, typer
    )
    fat = labels.is_fat(F.col("fs_type_code")) & F.col("meta_addr").isNotNull()
    flags = attributes.flags_json(
        time_precision=F.when(fat, "local-time-inferred"),
        assumed_timezone=F.when(fat, zone),
        hash_skipped=F.col("hash_skipped"),
        file_type_provenance=F.col("file_type_provenance"),
    )
    none = F.lit(None)
    return rows.select(
        "evidence_source_id",
        "file_id",
        "volume_id",
        "volume_offset",
        "path",
        "name",
        "parent_addr",
        "meta_addr",
        "fs_type",
        "size",
        "allocated",
        "meta_type",
        "uid",
        "gid",
        "mode",
        "md5",
        "sha1",
        "sha256",
        "mtime_utc",
        "atime_utc",
        "ctime_utc",
        "crtime_utc",
        "timestamp_source",
        "file_type",
        none.cast("boolean").alias("recovered"),
        none.cast("string").alias("confidence_tier"),
        none.cast("string").alias("recovered_path"),
        none.cast("boolean").alias("is_orphan"),
        flags.alias("attributes"),
    )


def split_volumes(volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable volumes, and a limitation row for each one that could not be opened.

    ``volumes``: evidence_source_id, volume_id, volume_offset, description,
    error (NULL when readable), head (leading bytes).
    """
    limits = volumes.where("error is not null").select(
        "evidence_source_id",
        "volume_id",
        "volume_offset",
        F.col("description").alias("detected_desc"),
        F.col("error").alias("reason"),
        attributes.flags_json(encryption_hint=signatures.container_hint(F.col("head"))).alias(
            "attributes"
        ),
    )
    return volumes.where("error is null"), limits
