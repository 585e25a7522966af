"""Intermediate tables in the shared folder, and sizes that follow the input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from caseframe.session import shared_folder

__all__ = ["partitions", "shared_folder", "staged"]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends, a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
