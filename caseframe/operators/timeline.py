"""File rows to timeline events, and the merged super-timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.functions import names
from caseframe.operators import ordered
from caseframe.schemas import ORDER_TIMELINE, TIMELINE_EVENTS

# Timestamp column to event type.
MACB_EVENTS = {
    "mtime_utc": "modified",
    "atime_utc": "accessed",
    "ctime_utc": "changed",
    "crtime_utc": "born",
}


def macb_events(files: DataFrame) -> DataFrame:
    """One event per recorded timestamp; a map-only unpivot."""
    base = files.select(
        "evidence_source_id",
        "file_id",
        "volume_id",
        "volume_offset",
        "path",
        "meta_addr",
        names.owner_actor(F.col("uid"), F.col("gid")).alias("actor"),
        F.when(
            F.coalesce(F.col("fs_type"), F.lit("")) != "",
            F.concat(F.lit("filesystem:"), F.col("fs_type")),
        )
        .otherwise("filesystem")
        .alias("source"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(kind).alias("event_type"), F.col(column).alias("ts_utc"))
                    for column, kind in MACB_EVENTS.items()
                ]
            )
        ).alias("e"),
    ).where("e.ts_utc is not null")
    none = F.lit(None)
    return base.select(
        "evidence_source_id",
        "file_id",
        "e.ts_utc",
        F.lit(False).alias("is_undated"),
        "source",
        "e.event_type",
        "volume_id",
        "volume_offset",
        "path",
        "meta_addr",
        "actor",
        none.cast("string").alias("action"),
        none.cast("string").alias("outcome"),
        none.cast("long").alias("line_ord"),
        none.cast("int").alias("line_sub"),
        F.lit("{}").alias("attributes"),
    )


def merge(*event_tables: DataFrame) -> DataFrame:
    """All event tables as one."""
    out = event_tables[0].select(TIMELINE_EVENTS.fieldNames())
    for other in event_tables[1:]:
        out = out.unionByName(other.select(TIMELINE_EVENTS.fieldNames()))
    return out


def in_order(events: DataFrame) -> DataFrame:
    """The declared total order. Undated events hold the largest instant, so they come last."""
    return ordered.by_day(events, ORDER_TIMELINE).drop("_before")


def positions(events: DataFrame) -> DataFrame:
    """The same order with 1-based positions."""
    return ordered.numbered_by_day(events, ORDER_TIMELINE)


def first_n(events: DataFrame, n: int = 2000) -> DataFrame:
    return ordered.top_n(events, ORDER_TIMELINE, n)
