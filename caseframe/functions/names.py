"""Paths and untrusted names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything that is not printable (the plain space is), and the colon.
_UNSAFE = r"[\p{C}\p{Z}&&[^ ]]|:"


def leaf(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory part without the trailing slash; '' for the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def home_owner(path: Column) -> Column:
    """User of a ``/home/<user>/`` path, else NULL."""
    return F.nullif(F.regexp_extract(path, "/home/([^/]+)/", 1), F.lit(""))


def sanitize(name: Column) -> Column:
    """Relative, control-free form of an untrusted name; '' if nothing survives."""
    parts = F.split(F.regexp_replace(name, r"\\", "/"), "/")
    kept = F.filter(parts, lambda p: ~p.isin("", ".", ".."))
    cleaned = F.transform(
        kept,
        lambda p: F.regexp_replace(F.regexp_replace(p, _UNSAFE, "_"), r"^\s+|\s+$", ""),
    )
    return F.array_join(F.filter(cleaned, lambda p: p != ""), "/")


def is_confined(name: Column) -> Column:
    """False for absolute names and names with a ``..`` component."""
    slashed = F.regexp_replace(name, r"\\", "/")
    return ~slashed.startswith("/") & ~F.array_contains(F.split(slashed, "/"), "..")


def recovered_path(
    volume_id: Column, volume_offset: Column, meta_addr: Column, name: Column
) -> Column:
    """``recovered/vol<id>-off<off>/<addr>-<safe name>``."""
    safe = sanitize(name)
    return F.concat(
        F.lit("recovered/vol"),
        volume_id.cast("string"),
        F.lit("-off"),
        volume_offset.cast("string"),
        F.lit("/"),
        meta_addr.cast("string"),
        F.lit("-"),
        F.when(safe == "", "unnamed").otherwise(safe),
    )


def owner_actor(uid: Column, gid: Column) -> Column:
    """``uid=..,gid=..`` from the known parts only; NULL when neither is known."""
    joined = F.concat_ws(
        ",",
        F.when(uid.isNotNull(), F.concat(F.lit("uid="), uid.cast("string"))),
        F.when(gid.isNotNull(), F.concat(F.lit("gid="), gid.cast("string"))),
    )
    return F.nullif(joined, F.lit(""))
