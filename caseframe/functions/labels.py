"""Numeric file-system codes to stable labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-system type codes of the inventory by family.
FAT_CODES = (2, 4, 8)
NTFS_CODES = (1,)
EXT_CODES = (128, 256, 8192)

# Inode type codes.
META_TYPES = {
    1: "reg",
    2: "dir",
    3: "fifo",
    4: "chr",
    5: "blk",
    6: "lnk",
    8: "sock",
    10: "virt",
    11: "virt_dir",
}

# Directory-entry type codes (another numbering).
NAME_TYPES = {
    1: "fifo",
    2: "chr",
    3: "dir",
    4: "blk",
    5: "reg",
    6: "lnk",
    7: "sock",
    10: "virt",
    11: "virt_dir",
}

# Where a family's timestamps come from.
TIMESTAMP_SOURCES = {
    "ext": "ext4:inode",
    "ntfs": "ntfs:$STANDARD_INFORMATION",
    "fat": "fat:dir-entry",
}

# Structural labels of entries without byte content.
STRUCTURAL_TYPES = {"dir": "directory", "lnk": "symlink"}


def lookup(table: dict, key: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(literal, key)


def is_fat(code: Column) -> Column:
    return F.coalesce(code.isin(*FAT_CODES), F.lit(False))


def fs_type_label(code: Column) -> Column:
    return (
        F.when(code.isin(*FAT_CODES), "fat")
        .when(code.isin(*NTFS_CODES), "ntfs")
        .when(code.isin(*EXT_CODES), "ext")
        .otherwise("unknown")
    )


def meta_type_label(meta_code: Column, name_code: Column) -> Column:
    """Inode type, else directory-entry type, else ``unknown``."""
    return F.coalesce(
        lookup(META_TYPES, meta_code.cast("int")),
        lookup(NAME_TYPES, name_code.cast("int")),
        F.lit("unknown"),
    )


def timestamp_source(fs_label: Column) -> Column:
    return lookup(TIMESTAMP_SOURCES, fs_label)


def structural_type(meta_type: Column) -> Column:
    return lookup(STRUCTURAL_TYPES, meta_type)
