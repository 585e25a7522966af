"""Session settings the operators rely on, and a builder for local runs."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Every timestamp is UTC, later flags win in a merge, and bad casts raise
# unless a try_ function is used. Rows that go to Python carry file contents,
# so an Arrow batch is bounded in bytes.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def pin(spark: SparkSession, batch: str = PINNED[BATCH]) -> SparkSession:
    """``batch``: bytes of an Arrow batch, held by the executor and its worker; memory, not results, depends on it."""
    for key, value in (PINNED | {BATCH: batch}).items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in a local session that names none."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="caseframe-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("caseframe")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in PINNED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return pin(spark)
