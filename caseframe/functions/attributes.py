"""Flags as JSON text with sorted keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flags_json(**values: Column) -> Column:
    """JSON text of the non-null flags with sorted keys; numbers, truth values and lists keep their type."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(values.items())]))


def merged(extra: Column, flags: Column) -> Column:
    """Two JSON objects as one with sorted keys; a key of ``flags`` wins, and values keep their type.

    An ``extra`` that is NULL or no object leaves the flags as they are.
    """
    kind = "map<string,variant>"
    both = F.map_concat(F.from_json(extra, kind), F.from_json(flags, kind))
    in_order = F.array_sort(
        F.map_entries(both), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    )
    return F.when(is_json_object(extra), F.to_json(F.map_from_entries(in_order))).otherwise(flags)


def is_json_object(text: Column) -> Column:
    """True when the text parses and its top level is an object."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))
