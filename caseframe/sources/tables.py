"""Case tables: scoped reads, appends, ordered writes and the report sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe import schemas
from caseframe.operators import ordered, quality

PARTITION = "evidence_source_id"

# A second partition level, computed from the rows: folders only, no column of the table.
FAMILY = "family"
FILESYSTEM, LOG = "filesystem", "log"
FAMILIES = {"timeline_events": f"case when startswith(source, '{FILESYSTEM}') then '{FILESYSTEM}' else '{LOG}' end"}


class CaseTables:
    """Parquet tables of one case under a root folder.

    Every table with an ``evidence_source_id`` is partitioned by it, so a
    scoped read prunes to the folders of that source.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        return self._is_there(self.path(table))

    def _is_there(self, folder: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def has_family(self, table: str, evidence_source_id: int, family: str) -> bool:
        """Whether a family has rows of a source, told from the folders alone: one is made with its first row."""
        return self._is_there(f"{self.path(table)}/{PARTITION}={int(evidence_source_id)}/{FAMILY}={family}")

    def read(self, table: str, evidence_source_id: int | None = None, family: str | None = None) -> DataFrame:
        """A table in its declared schema; an absent table reads as empty.

        A source, and a family where the table has them, are read from their folders alone.
        """
        schema = schemas.TABLES[table]
        if family is not None and table not in FAMILIES:
            raise ValueError(f"{table} has no families")
        if not self.exists(table):
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([*schema.fields, T.StructField(FAMILY, T.StringType())]) if table in FAMILIES else schema
        df = self.spark.read.schema(stored).parquet(self.path(table))
        if evidence_source_id is not None:
            df = df.where(F.col(PARTITION) == evidence_source_id)
        if family is not None:
            df = df.where(F.col(FAMILY) == family)
        return df.select(schema.fieldNames())

    def append(self, table: str, rows: DataFrame) -> None:
        self._write(table, self._with_folders(table, rows))

    def _with_folders(self, table: str, rows: DataFrame) -> DataFrame:
        schema = schemas.TABLES[table]
        quality.require_utc(quality.require_schema(rows, schema))
        named = rows.select(schema.fieldNames())
        return named.withColumn(FAMILY, F.expr(FAMILIES[table])) if table in FAMILIES else named

    def _write(self, table: str, rows: DataFrame) -> None:
        folders = [c for c in (PARTITION, FAMILY) if c in rows.columns]
        writer = rows.write.mode("append")
        (writer.partitionBy(*folders) if folders else writer).parquet(self.path(table))

    def append_in_order(self, table: str, rows: DataFrame, order: list[str]) -> None:
        """Append range-partitioned and sorted, so readers can skip by the leading keys.

        The partition columns lead, or the writer would sort by them once more.
        """
        placed = self._with_folders(table, rows)
        folders = [c for c in (PARTITION, FAMILY) if c in placed.columns]
        self._write(table, ordered.total_order(placed, [*folders, *order]))

    def staged(self, name: str, rows: DataFrame, evidence_source_id: int) -> DataFrame:
        """Write an intermediate result and read it back, so that nothing before it runs twice."""
        path = f"{self.root}/staging/{name}/{PARTITION}={evidence_source_id}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def record_stage(self, case_id: int, stage: str) -> None:
        """Note that a stage ran, once per case, whether or not it found anything."""
        if stage not in schemas.ENUMS["run_log"]["stage"]:
            raise ValueError(f"unknown stage {stage!r}")
        row = self.spark.createDataFrame([(case_id, stage)], schemas.RUN_LOG)
        self.append("run_log", quality.only_new(row, self.read("run_log"), ["case_id", "stage"]))

    def latest_source(self) -> int | None:
        return self.read("evidence_sources").agg(F.max("evidence_source_id")).first()[0]


def write_report(sections: dict[str, DataFrame], folder: str) -> None:
    """Small breakdowns as one JSON file each, keys sorted."""
    for name, df in sections.items():
        df.select(sorted(df.columns)).coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")


def write_listing(rows: DataFrame, order: list[str], path: str) -> None:
    """All rows with their position, as files in the declared order."""
    ordered.numbered(rows, order).write.mode("overwrite").parquet(path)


def write_recovered(contents: DataFrame, path: str, max_bytes: int | None = None) -> None:
    """Recovered contents by confined relative name; oversize content is written empty.

    ``contents``: recovered_path, size, content.
    """
    body = F.col("content")
    if max_bytes is not None:
        body = F.when(F.col("size") > max_bytes, F.lit(b"")).otherwise(body)
    contents.select("recovered_path", F.coalesce(body, F.lit(b"")).alias("content")).write.mode(
        "append"
    ).parquet(path)


def write_pieces(pieces: DataFrame, path: str) -> None:
    """Recovered contents as pieces (recovered_path, base, data), those of a file in order behind each other."""
    rows = pieces.select("recovered_path", "base", "data")
    ordered.total_order(rows, ["recovered_path", "base"]).write.mode("append").parquet(path)
