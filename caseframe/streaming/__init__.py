"""The row-wise operators on streams.

The batch operators that keep no state across rows run on a streaming
DataFrame as they are; these helpers combine them with a table sink. Year
inference needs a whole member and stays in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseframe.operators import known
from caseframe.operators.logs import parse


def stream_heads(lines: DataFrame) -> DataFrame:
    """Head fields and class of arriving lines of the head-based parsers."""
    headed = [p for p in parse.PARSERS if p.classify is not None]
    routed = lines.withColumn("parser", parse.route(F.col("path")))
    return parse.headed_records(routed.where(F.col("parser").isin([p.name for p in headed])), headed)


def stream_known(files: DataFrame, lists: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Annotate arriving file rows against static lists, one micro-batch at a time."""

    def annotate(batch: DataFrame, batch_id: int) -> None:
        known.match_lists(batch, lists).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        files.writeStream.foreachBatch(annotate)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
