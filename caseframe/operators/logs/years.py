"""Years of year-less log heads.

Walking a member from its newest line back, the year drops by one where a late
month (July or later) meets an early one on its newer side, provided the next
older line is late as well or the month is November or December. Only half-year
symbols matter, so the walk has a window form:

    L   month <= 6
    W   month >= 7, and the line is the oldest, or the next older line is late,
        or month >= 11
    -   otherwise

A year boundary lies at a W whose nearest symbol on the newer side is L; the
year of a line is the seed year minus the boundaries from the newest line down
to it.

A member can hold a large share of all lines, so the windows run inside
segments of the member. One row per segment carries over what crosses the
edges: the month of the next older line, the nearest symbol on the newer side
and the number of boundaries so far.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from caseframe.operators.ordered import SEG, SEGMENT, with_segment


def _symbol(month: Column, older: Column) -> Column:
    return F.when(month <= 6, "L").when(
        (month >= 7) & (older.isNull() | (older >= 7) | (month >= 11)), "W"
    )


def _boundary(symbol: Column, newer: Column) -> Column:
    return F.coalesce((symbol == "W") & (newer == "L"), F.lit(False)).cast("int")


def _newest_first(part: list[str], order: list[str]) -> WindowSpec:
    """Rows without a month behind all others, so that they influence nothing.

    The flag is a column: as an expression it would be named anew by every
    window, and each of them would sort again.
    """
    return W.partitionBy(*part).orderBy("_undated", *[F.col(c).desc() for c in order])


def segment_carry(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    segment_rows: int = SEGMENT,
    majors: Sequence[str] = (),
) -> DataFrame:
    """One row per (key, segment) with what its newest line needs to know.

    Columns: keys, segment, older_month, carry_symbol, carry_boundaries. Every
    segment of ``rows`` is present, also those without a datable line.
    """
    part = [*keys, *majors, SEG]
    narrow = with_segment(
        rows.select(*keys, *majors, *order, "month"), order[0], segment_rows
    ).withColumn("_undated", F.col("month").isNull())
    undated = F.col("_undated")
    newest_first = _newest_first(part, order)
    newer_side = newest_first.rowsBetween(W.unboundedPreceding, -1)
    # Inside a segment its oldest datable line stays open: what lies behind it
    # is only known at the next level.
    inner = (
        narrow.withColumn("_older", F.lead("month").over(newest_first))
        .withColumn(
            "_sym",
            F.when(~undated & F.col("_older").isNotNull(), _symbol(F.col("month"), F.col("_older"))),
        )
        .withColumn("_newer", F.last("_sym", ignorenulls=True).over(newer_side))
        .withColumn("_b", _boundary(F.col("_sym"), F.col("_newer")))
    )
    at = F.struct(*order)
    with_month, with_sym = F.when(~undated, at), F.when(F.col("_sym").isNotNull(), at)
    summary = inner.groupBy(*part).agg(
        F.max_by("month", with_month).alias("m_new"),
        F.min_by("month", with_month).alias("m_old"),
        F.max_by("_sym", with_sym).alias("s_new"),
        F.min_by("_sym", with_sym).alias("s_old"),
        F.sum("_b").alias("b_in"),
    )
    line = [*majors, SEG]
    forth = W.partitionBy(*keys).orderBy(*line).rowsBetween(W.unboundedPreceding, -1)
    newer_segments = (
        W.partitionBy(*keys)
        .orderBy(*[F.col(c).desc() for c in line])
        .rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        summary.withColumn("older_month", F.last("m_new", ignorenulls=True).over(forth))
        .withColumn("_edge", _symbol(F.col("m_old"), F.col("older_month")))
        .withColumn(
            "carry_symbol",
            F.last(F.coalesce("_edge", "s_old"), ignorenulls=True).over(newer_segments),
        )
        .withColumn(
            "_b_total",
            F.col("b_in")
            + _boundary(F.col("s_new"), F.col("carry_symbol"))
            + _boundary(F.col("_edge"), F.coalesce("s_old", "carry_symbol")),
        )
        .withColumn("carry_boundaries", F.coalesce(F.sum("_b_total").over(newer_segments), F.lit(0)))
        .select(*part, "older_month", "carry_symbol", "carry_boundaries")
    )


def infer(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    per_key: DataFrame,
    segment_rows: int = SEGMENT,
    majors: Sequence[str] = (),
) -> DataFrame:
    """Add ``year`` (NULL for rows without a month) and the columns of ``per_key``.

    A key is ordered by ``majors`` (the member of a set, say), then ``order``.
    ``per_key`` has one row per key and majors and must contain ``seed_year``.
    It is joined to the segment table, not to the rows, so a long member never
    becomes one hot join key.
    """
    part = [*keys, *majors, SEG]
    carry = segment_carry(rows, keys, order, segment_rows, majors).join(
        per_key, [*keys, *majors], "left"
    )
    joined = (
        with_segment(rows, order[0], segment_rows)
        .join(carry, part)
        .withColumn("_undated", F.col("month").isNull())
    )
    undated = F.col("_undated")
    newest_first = _newest_first(part, order)
    newer_side = newest_first.rowsBetween(W.unboundedPreceding, -1)
    up_to_here = newest_first.rowsBetween(W.unboundedPreceding, 0)
    out = (
        joined.withColumn("_older", F.coalesce(F.lead("month").over(newest_first), F.col("older_month")))
        .withColumn("_sym", F.when(~undated, _symbol(F.col("month"), F.col("_older"))))
        .withColumn(
            "_newer",
            F.coalesce(F.last("_sym", ignorenulls=True).over(newer_side), F.col("carry_symbol")),
        )
        .withColumn("_b", _boundary(F.col("_sym"), F.col("_newer")))
        .withColumn("_n", F.col("carry_boundaries") + F.sum("_b").over(up_to_here))
        .withColumn("year", F.when(~undated, F.col("seed_year") - F.col("_n")).cast("int"))
    )
    return out.drop(
        SEG, "_undated", "older_month", "carry_symbol", "carry_boundaries", "_older", "_sym", "_newer", "_b", "_n"
    )
