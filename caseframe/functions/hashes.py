"""Content digests and hash-list tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALGORITHMS = ("md5", "sha1", "sha256")
HEX_LENGTHS = {32: "md5", 40: "sha1", 64: "sha256"}


def digest(content: Column, algorithm: str) -> Column:
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256)}[algorithm](content)


def algorithm_of(token: Column) -> Column:
    size = F.length(token)
    expr = None
    for n, algo in HEX_LENGTHS.items():
        expr = F.when(size == n, algo) if expr is None else expr.when(size == n, algo)
    return expr


def is_hex(token: Column) -> Column:
    return token.rlike("^[0-9A-Fa-f]+$")
