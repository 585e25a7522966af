"""Content type and container hints by leading bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD_BYTES = 4096
EMPTY_TYPE = "inode/x-empty"

# Fixed values: (offset, magic bytes, type), best first. A documented subset of
# well-known signatures; anything else is text or opaque bytes.
SIGNATURES: tuple[tuple[int, bytes, str], ...] = (
    (0, b"\x89PNG\r\n\x1a\n", "image/png"),
    (0, b"\xff\xd8\xff", "image/jpeg"),
    (0, b"GIF87a", "image/gif"),
    (0, b"GIF89a", "image/gif"),
    (0, b"%PDF-", "application/pdf"),
    (0, b"PK\x03\x04", "application/zip"),
    (0, b"\x1f\x8b", "application/gzip"),
    (0, b"BZh", "application/x-bzip2"),
    (0, b"\xfd7zXZ\x00", "application/x-xz"),
    (0, b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"),
    (0, b"\x7fELF", "application/x-executable"),
    (0, b"MZ", "application/x-dosexec"),
    (0, b"SQLite format 3\x00", "application/vnd.sqlite3"),
    (257, b"ustar", "application/x-tar"),
    (0, b"#!", "text/x-shellscript"),
    (0, b"<?xml", "text/xml"),
    (0, b"<!DOCTYPE html", "text/html"),
    (0, b"<!doctype html", "text/html"),
    (0, b"<html", "text/html"),
)

# Fixed values: (window, marker, label) for encrypted containers on a volume
# head; a window equal to the marker length means "starts with".
CONTAINER_MARKERS: tuple[tuple[int, bytes, str], ...] = (
    (6, b"LUKS\xba\xbe", "likely LUKS"),
    (16, b"-FVE-FS-", "likely BitLocker"),
)

# Control bytes that do not occur in text files.
_BINARY_BYTES = "[\\x00-\\x06\\x0e-\\x1a\\x1c-\\x1f\\x7f]"


def _magic_at(head: Column, offset: int, magic: bytes) -> Column:
    return F.substring(head, offset + 1, len(magic)) == F.lit(magic)


def file_type(content: Column) -> Column:
    """Type from the first 4096 bytes; empty content has its own label, NULL stays NULL."""
    head = F.substring(content, 1, HEAD_BYTES)
    expr = F.when(content.isNull(), F.lit(None).cast("string")).when(
        F.octet_length(content) == 0, EMPTY_TYPE
    )
    for offset, magic, mime in SIGNATURES:
        expr = expr.when(_magic_at(head, offset, magic), mime)
    opaque = F.decode(head, "ISO-8859-1").rlike(_BINARY_BYTES)
    return expr.when(opaque, "application/octet-stream").otherwise("text/plain")


def container_hint(volume_head: Column) -> Column:
    """Label of an encrypted container, or NULL."""
    expr = None
    for window, marker, label in CONTAINER_MARKERS:
        hit = F.contains(F.substring(volume_head, 1, window), F.lit(marker))
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return expr
