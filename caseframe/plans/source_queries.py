"""Sources and sinks over files that are written from the tables first."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe import schemas
from caseframe.operators import inventory, quality, report
from caseframe.plans.log_queries import BREAKS
from caseframe.plans.registry import query
from caseframe.plans.views import table, view
from caseframe.session import shared_folder
from caseframe.sources import evidence, text
from caseframe.sources.tables import CaseTables

DOCS_PER_VOLUME = 100
IMAGE_BLOCK = 512
IMAGE_OFFSET = 37


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in volumes of a fixed number, in order."""
    docs = table(spark, sf_dir, "documents").select(F.expr(f"doc_id div {DOCS_PER_VOLUME}").alias("v"), "doc_id", "text")
    return docs.where("text is not null").repartition("v").sortWithinPartitions("v", "doc_id")


_IMAGES = f"""images AS (SELECT doc_id // {DOCS_PER_VOLUME} AS v, hex(encode(string_agg(text || chr(10), '' ORDER BY doc_id))) AS h
    FROM documents WHERE text IS NOT NULL GROUP BY ALL)"""


@query(
    "src_blocks",
    f"""WITH {_IMAGES}, sized AS (SELECT v, substring(h, {2 * IMAGE_OFFSET} + 1) AS h FROM images),
    cut AS (SELECT v, h, unnest(range((len(h) // 2 + {IMAGE_BLOCK - 1}) // {IMAGE_BLOCK})) AS b FROM sized),
    blocks AS (SELECT v, b, substring(h, b * {2 * IMAGE_BLOCK} + 1, {2 * IMAGE_BLOCK}) AS d FROM cut)
    SELECT v AS volume_id, CAST({IMAGE_OFFSET} AS BIGINT) AS volume_offset, CAST(b AS BIGINT) AS block_index,
      CAST(len(d) // 2 AS BIGINT) AS length, md5(unhex(d)) AS md5 FROM blocks""",
)
def src_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of raw images written from the documents: odd volume offset, short last block."""
    folder = _folder(spark, "images")
    _volumes(spark, sf_dir).select("v", "text").write.partitionBy("v").text(folder)
    files = spark.read.format("binaryFile").load(folder).select("path", "v").collect()  # names only
    images = [evidence.Image(r.path, int(r.v), IMAGE_OFFSET) for r in files]
    blocks = evidence.read_images(spark, images, IMAGE_BLOCK)
    return blocks.select(
        "volume_id", "volume_offset", "block_index", F.octet_length("data").cast("long").alias("length"), F.md5("data").alias("md5")
    )


@query(
    "src_tree",
    f"""WITH {_IMAGES} SELECT v AS volume_id, CAST(len(h) // 2 AS BIGINT) AS size, sha256(unhex(h)) AS sha256 FROM images""",
)
def src_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a tree with their contents."""
    folder = _folder(spark, "tree")
    _volumes(spark, sf_dir).select("v", "text").write.partitionBy("v").text(folder)
    files = evidence.read_tree(spark, folder)
    volume = F.regexp_extract("path", "/v=([0-9]+)/", 1).cast("long")
    return files.where(F.col("path").rlike("/v=")).select(volume.alias("volume_id"), "size", F.sha2("content", 256).alias("sha256"))


@query(
    "src_log_gz",
    f"""SELECT doc_id // {DOCS_PER_VOLUME} AS volume_id, line, CAST(COUNT(*) AS BIGINT) AS copies
    FROM (SELECT doc_id, unnest(string_split_regex(text, '{BREAKS}')) AS line FROM documents WHERE text IS NOT NULL)
    WHERE regexp_matches(line, '\\S') GROUP BY ALL""",
)
def src_log_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of gzip members written from the documents, inflated in pieces; blank ones are left out."""
    folder = _folder(spark, "members")
    _volumes(spark, sf_dir).select("v", "text").write.partitionBy("v").option("compression", "gzip").text(folder)
    files = spark.read.format("binaryFile").load(folder)
    members = files.select(F.col("v").cast("long").alias("volume_id"), "path", F.lit(True).alias("is_gz"), "content")
    lines = text.lines_of_members(members).where(F.col("line").rlike(r"(?U)\S"))
    return lines.groupBy("volume_id", "line").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "src_reference",
    "SELECT upper(md5(text)) AS md5, CAST(COUNT(*) AS BIGINT) AS entries FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL GROUP BY ALL",
)
def src_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference hash export as Parquet and as CSV, of which the better variant is read."""
    rows = table(spark, sf_dir, "documents").where("doc_id % 3 = 0 and text is not null").selectExpr("upper(md5(text)) as md5", "doc_id")
    parquet, csv = _folder(spark, "reference"), _folder(spark, "reference")
    rows.where("doc_id % 2 = 0").write.parquet(f"{parquet}/FILE")
    rows.limit(0).write.parquet(f"{parquet}/METADATA")
    rows.where("doc_id % 2 = 1").write.option("header", "true").csv(f"{csv}/METADATA")
    both = evidence.read_reference(spark, parquet).select("md5").unionByName(evidence.read_reference(spark, csv, "csv").select("md5"))
    return both.groupBy("md5").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "case_append",
    """SELECT evidence_source_id, CAST(COUNT(*) AS BIGINT) AS rows, CAST(SUM(file_id) AS BIGINT) AS ids FROM files_v
    WHERE evidence_source_id = 2 GROUP BY ALL""",
    ("files_v",),
)
def case_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended to a case in two parts and read back for one source."""
    tables = CaseTables(spark, _folder(spark, "case"))
    files = view(spark, sf_dir, "files_v")
    shaped = files.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in files.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schemas.FILES.fields
    ])
    for part in (0, 1):
        tables.append("files", shaped.where(F.col("file_id") % 2 == part))
    read = tables.read("files", 2)
    return read.groupBy("evidence_source_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("file_id").alias("ids"))


@query(
    "user_typer",
    """SELECT file_id, CASE WHEN size = 0 THEN 'inode/x-empty' ELSE 'text/x-' || strlen(content_text) % 5 END AS file_type
    FROM files_v WHERE meta_type = 'reg'""",
    ("files_v",),
)
def user_typer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file typer of the user, a vectorised function, in place of the signatures."""

    @F.pandas_udf("string")
    def typer(content: pd.Series) -> pd.Series:
        return "text/x-" + (content.str.len() % 5).astype(str)

    files = view(spark, sf_dir, "files_v").withColumn("content", F.col("content_text").cast("binary"))
    entries = files.select("file_id", "meta_type", F.coalesce("allocated", F.lit(False)).alias("allocated"), "content", "size")
    return inventory.with_content_fields(entries, None, typer).where("meta_type = 'reg'").select("file_id", "file_type")


@query(
    "volume_limits",
    """SELECT CAST(1 AS BIGINT) AS evidence_source_id, s_suppkey AS volume_id, s_name AS detected_desc, 'cannot open' AS reason,
      CASE WHEN s_suppkey % 6 = 0 THEN '{"encryption_hint":"likely LUKS"}' WHEN s_suppkey % 6 = 2 THEN '{"encryption_hint":"likely BitLocker"}' ELSE '{}' END AS attributes
    FROM supplier WHERE s_suppkey % 2 = 0""",
)
def volume_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes that could not be opened, with what their first bytes hint at."""
    head = F.when(F.col("s_suppkey") % 6 == 0, F.lit(b"LUKS\xba\xbe\0\1")).when(F.col("s_suppkey") % 6 == 2, F.lit(b"\xebX\x90-FVE-FS-\0")).otherwise(F.lit(b"\0" * 16))
    rows = table(spark, sf_dir, "supplier").select(
        F.lit(1).cast("long").alias("evidence_source_id"), F.col("s_suppkey").alias("volume_id"), F.lit(0).cast("long").alias("volume_offset"),
        F.col("s_name").alias("description"), F.when(F.col("s_suppkey") % 2 == 0, "cannot open").alias("error"), head.alias("head"),
    )
    _, limits = inventory.split_volumes(rows)
    return limits.select("evidence_source_id", "volume_id", "detected_desc", "reason", "attributes")


@query(
    "integrity_report",
    """WITH f AS (SELECT path, sha256, md5, file_id FROM files_v WHERE sha256 IS NOT NULL AND (recovered IS NULL OR NOT recovered)),
    r AS (SELECT *, CASE file_id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'MALFORMED' ELSE 'NOT_COMPARED' END AS outcome FROM f)
    SELECT CAST(COUNT(*) FILTER (WHERE outcome <> 'NOT_COMPARED') AS BIGINT) AS compared, CAST(COUNT(*) FILTER (WHERE outcome = 'NOT_COMPARED') AS BIGINT) AS not_compared,
      CAST(COUNT(*) FILTER (WHERE outcome = 'FAIL') AS BIGINT) AS mismatches, CAST(COUNT(*) FILTER (WHERE outcome = 'MALFORMED') AS BIGINT) AS malformed,
      CAST(COUNT(*) FILTER (WHERE file_id % 5 = 0) AS BIGINT) AS drifted,
      COUNT(*) FILTER (WHERE outcome <> 'NOT_COMPARED') > 0 AS acquisition_supplied,
      COUNT(*) FILTER (WHERE outcome <> 'NOT_COMPARED') > 0 AND COUNT(*) FILTER (WHERE outcome IN ('FAIL', 'MALFORMED')) = 0 AS acquisition_compare_pass,
      COUNT(*) FILTER (WHERE file_id % 5 = 0) = 0 AS reverify_pass,
      COUNT(*) FILTER (WHERE outcome IN ('FAIL', 'MALFORMED')) + COUNT(*) FILTER (WHERE file_id % 5 = 0) = 0 AS passed FROM r""",
    ("files_v",),
)
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integrity section of a report: acquisition compare and re-verification of every file with digests."""
    files = view(spark, sf_dir, "files_v").where("sha256 is not null and recovered is not true").select("path", "md5", "sha256", "file_id")
    k = F.col("file_id") % 4
    supplied = F.when(k == 0, F.upper("sha256")).when(k == 1, F.lit("0" * 64)).when(k == 2, "no digest")
    verified = quality.verify_manifest(files, files.select("path", supplied.alias("supplied")))
    before = files.withColumn("sha256", F.when(F.col("file_id") % 5 == 0, "other").otherwise(F.col("sha256")))
    drift = quality.manifest_drift(before, files)
    return report.integrity(quality.acquisition_rows(verified, 1).unionByName(quality.drift_rows(drift, 1)))

