"""Ordered state over long keys without putting a key in one task.

A key (a log member, a volume) may hold a large share of all rows, so its rows
are cut into segments of consecutive order values. Windows run inside a
segment; what crosses a segment edge is carried by one summary row per segment.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseframe.session import shared_folder

SEGMENT = 1_000_000
SEG = "_seg"
#: Rows of a range: as many as the shuffle partitions ask for, but not fewer and not more than these.
RANGE_ROWS = (1 << 16, 1 << 20)
#: Rows that are looked at for each range of a split day.
SAMPLED = 64
DAY_MICROS = 86_400_000_000


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row.

    A filter on a plain projected column is pushed below the projection with
    its expression copied, which for a regex means matching again and again.
    Nothing is pushed below a generator.
    """
    return df.select(*df.columns, F.explode(F.array(value)).alias(name))


def with_segment(df: DataFrame, order_col: str, rows: int = SEGMENT) -> DataFrame:
    """Number the stretches of ``rows`` consecutive order values."""
    return df.withColumn(SEG, F.expr(f"{order_col} div {int(rows)}"))


def with_previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[str],
    out: str = "prev",
    rows: int = SEGMENT,
) -> DataFrame:
    """Add ``out``: a struct of ``values`` from the preceding row of the key."""
    part = [*keys, SEG]
    seg = with_segment(df, order[0], rows)
    payload = F.struct(*values)
    last = seg.groupBy(*part).agg(F.max_by(payload, F.struct(*order)).alias("_last"))
    carry = last.select(
        *part, F.lag("_last").over(W.partitionBy(*keys).orderBy(SEG)).alias("_carry")
    )
    inside = W.partitionBy(*part).orderBy(*order)
    return (
        seg.join(carry, part, "left")
        .withColumn(out, F.coalesce(F.lag(payload).over(inside), F.col("_carry")))
        .drop("_carry", SEG)
    )


def total_order(df: DataFrame, columns: list[str], partitions: int | None = None) -> DataFrame:
    """Distributed sort for writing: range partitions, sorted inside, equal rows together."""
    ranged = (
        df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    )
    return ranged.sortWithinPartitions(*columns)


def settled(df: DataFrame) -> DataFrame:
    """Put an exchange behind a costly result before it is sorted.

    A range sort samples its input first, which would run everything before it
    a second time; behind an exchange the sample reads the shuffled rows. The
    rows are spread evenly, so a hot source does not matter.
    """
    return df.hint("rebalance")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several jobs read to the checkpoint folder, and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_day(df: DataFrame, columns: list[str], rows: tuple[int, int] = RANGE_ROWS) -> DataFrame:
    """All rows in the declared order, whose first column is an instant, with ``_before``: the rows of the partitions before.

    The rows are counted by day, which needs nothing but their instants, and
    days are put together to ranges; no row is evaluated in full to be sampled.
    A day of more than two ranges is split at sampled rows, in the full order,
    and its parts are counted as well. So a range is known by the row alone and
    a second evaluation cuts at the same places. One count a day or part reaches
    the driver.
    """
    spark, least, most = df.sparkSession, *rows
    day = F.coalesce(F.expr(f"unix_micros(`{columns[0]}`) div {DAY_MICROS}"), F.lit(-(1 << 40)))
    dated = df.withColumn("_day", day)
    counts = dict(map(tuple, dated.groupBy("_day").count().collect()))
    aim = min(most, max(least, -(-sum(counts.values()) // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    large = [(d, n) for d, n in counts.items() if n > 2 * aim]
    below = F.lit(0)
    if large:
        rate = min(1.0, SAMPLED / aim)
        every, key = max(1, round(rate * aim)), F.struct(*columns)
        of_large = dated.join(F.broadcast(spark.createDataFrame(large, "_day long, _n long")), "_day")
        picked = of_large.select("_day", key.alias("_key")).where(F.rand(0) < rate).groupBy("_day").agg(F.sort_array(F.collect_list("_key")).alias("_keys"))
        cuts = F.array_distinct(F.filter("_keys", lambda _, i: (i > 0) & (i % every == 0)))
        cuts = stored(picked.select("_day", cuts.alias("_cuts")), "cuts")
        below = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda cut: cut <= key)))
        split = dated.join(F.broadcast(spark.createDataFrame(large, "_day long, _n long")), "_day").join(F.broadcast(cuts), "_day", "left")
        inside = {(r["_day"], r["_below"]): r["count"] for r in split.groupBy("_day", below.alias("_below")).count().collect()}

    places, part, held, before = [], -1, 0, 0
    split_days = {d for d, _ in large}
    for d in sorted(counts):
        if d in split_days:
            starts = []
            for k in range(1 + max(k for e, k in inside if e == d)):
                starts.append(before)
                before += inside.get((d, k), 0)
            places.append((d, part + 1, starts))
            part, held = part + len(starts), most
        else:
            if part < 0 or held + counts[d] > aim:
                part, held, start = part + 1, 0, before
            places.append((d, part, [start]))
            held, before = held + counts[d], before + counts[d]
    placed = dated.join(F.broadcast(spark.createDataFrame(places, "_day long, _first int, _starts array<long>")), "_day")
    if large:
        placed = placed.join(F.broadcast(cuts), "_day", "left")
    placed = placed.select(*df.columns, (F.col("_first") + below).alias("_part"), F.get("_starts", below).alias("_before"))
    return placed.repartitionById(part + 1 or 1, "_part").sortWithinPartitions(*columns).drop("_part")


def numbered_by_day(df: DataFrame, columns: list[str], rows: tuple[int, int] = RANGE_ROWS, name: str = "position") -> DataFrame:
    """Every row with its 1-based position in the declared order, in that order; nothing is written between."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return by_day(df, columns, rows).select((F.col("_before") + inside + 1).alias(name), *df.columns)


def numbered(df: DataFrame, columns: list[str], partitions: int | None = None, name: str = "position") -> DataFrame:
    """Every row with its 1-based position in the declared order, in that order.

    Ranges are sorted in parallel and kept in the checkpoint folder, as a second
    evaluation may cut them elsewhere; the rows of each partition are counted,
    and its first position is the sum of the counts before. Nothing runs over
    all rows in one task; only one count a partition reaches the driver.
    """
    shared_folder(df.sparkSession)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = total_order(df, columns, partitions).withColumns({"_part": F.spark_partition_id(), "_row": inside}).checkpoint()
    before, offsets = 0, []
    for part, n in kept.groupBy("_part").count().orderBy("_part").collect():
        offsets.append((part, before))
        before += n
    first = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    placed = kept.join(F.broadcast(first), "_part")
    return placed.select((F.col("_before") + F.col("_row") + 1).alias(name), *df.columns)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a source with fewer partitions than cores, as one small file is; larger ones stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def top_n(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """First ``n`` rows of the declared order together with the true total.

    The limit is a per-partition top-n and the total a plain count, so nothing
    is sorted in full; ``truncated`` says whether rows are left out.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    first = df.orderBy(*columns).limit(n)
    ranked = first.withColumn("position", F.row_number().over(W.orderBy(*columns)).cast("long"))
    return ranked.withColumn("total", total.scalar()).withColumn("truncated", F.col("total") > n)
