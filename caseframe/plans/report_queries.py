"""Report breakdowns, case reads, checks and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.functions import attributes, signatures
from caseframe.operators import quality, report
from caseframe.plans.inventory_queries import _CONTENTS_SQL, _TYPE_CASE, contents
from caseframe.plans.registry import query
from caseframe.plans.views import table, view

_INVENTORY = "inventory AS (SELECT * FROM files_v WHERE recovered IS NOT TRUE)"


@query(
    "case_read_scoped",
    "SELECT file_id, path, size, allocated FROM files_v WHERE evidence_source_id = 2",
    ("files_v",),
)
def case_read_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one evidence source."""
    return view(spark, sf_dir, "files_v").where("evidence_source_id = 2").select("file_id", "path", "size", "allocated")


@query(
    "latest_source",
    "SELECT CAST(MAX(evidence_source_id) AS BIGINT) AS evidence_source_id FROM files_v",
    ("files_v",),
)
def latest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest evidence source."""
    return view(spark, sf_dir, "files_v").agg(F.max("evidence_source_id").alias("evidence_source_id"))


@query(
    "inventory_counts",
    f"""WITH {_INVENTORY} SELECT CAST(COUNT(*) AS BIGINT) AS file_count,
      CAST(COUNT(*) FILTER (WHERE meta_type = 'dir') AS BIGINT) AS directory_count,
      CAST(COUNT(*) FILTER (WHERE allocated = false) AS BIGINT) AS deleted_count FROM inventory""",
    ("files_v",),
)
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, directories and deleted entries; unknown allocation is not deleted."""
    return report.inventory_counts(view(spark, sf_dir, "files_v"))


@query(
    "per_volume",
    f"""WITH {_INVENTORY} SELECT volume_id, volume_offset, arg_min(fs_type, file_id) FILTER (WHERE fs_type IS NOT NULL) AS fs_type,
      CAST(COUNT(*) AS BIGINT) AS file_count, CAST(COUNT(*) FILTER (WHERE allocated = false) AS BIGINT) AS deleted_count
    FROM inventory GROUP BY volume_id, volume_offset""",
    ("files_v",),
)
def per_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per volume with the first known file-system type."""
    return report.per_volume(view(spark, sf_dir, "files_v"))


@query(
    "walk_counts",
    f"""WITH {_INVENTORY} SELECT CAST(COUNT(*) AS BIGINT) AS files_inventoried,
      CAST(COUNT(*) FILTER (WHERE allocated = false) AS BIGINT) AS deleted_count,
      CAST(COUNT(DISTINCT volume_id) AS BIGINT) AS volumes_walked,
      (SELECT CAST(COUNT(*) AS BIGINT) FROM supplier) AS limitations_recorded FROM inventory""",
    ("files_v",),
)
def walk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of an inventory run with its limitation rows."""
    return report.walk_counts(view(spark, sf_dir, "files_v"), table(spark, sf_dir, "supplier"))


@query(
    "file_type_distribution",
    f"""WITH {_CONTENTS_SQL} SELECT {_TYPE_CASE.replace('looked_at', 'content')} AS file_type, CAST(COUNT(*) AS BIGINT) AS "count" FROM contents GROUP BY 1""",
)
def file_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content types, most frequent first."""
    typed = contents(spark, sf_dir).select(
        signatures.file_type(F.col("content")).alias("file_type"), F.lit(None).cast("boolean").alias("recovered")
    )
    return report.file_type_distribution(typed)


@query(
    "provenance_flags",
    """SELECT DISTINCT json_extract_string(attributes, '$.time_precision') AS time_precision,
      json_extract_string(attributes, '$.assumed_timezone') AS assumed_timezone,
      json_extract_string(attributes, '$.file_type_provenance') AS file_type_provenance
    FROM files_v WHERE attributes <> '{}'""",
    ("files_v",),
)
def provenance_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sets of provenance flags."""
    return report.provenance_flags(view(spark, sf_dir, "files_v"))


@query(
    "fk_violations",
    "SELECT event_id, user_id * 20 AS file_id FROM events WHERE user_id * 20 NOT IN (SELECT doc_id FROM documents)",
)
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that refer to a file that does not exist."""
    events = table(spark, sf_dir, "events").selectExpr("event_id", "user_id * 20 as file_id")
    files = table(spark, sf_dir, "documents").selectExpr("doc_id as file_id")
    return quality.orphan_references(events, files, ["file_id"]).select("event_id", "file_id")


_PROPS = "CASE WHEN event_id % 50 = 0 THEN '[' || event_id || ']' WHEN event_id % 51 = 0 THEN '{bad ' || props WHEN event_id % 52 = 0 THEN '\"x\"' ELSE props END"


@query(
    "attributes_valid",
    f"""WITH p AS (SELECT event_id, {_PROPS} AS attributes FROM events)
    SELECT event_id, CASE WHEN json_valid(attributes) THEN json_type(attributes) = 'OBJECT' ELSE false END AS valid FROM p""",
)
def attributes_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether attributes are a JSON object."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{_PROPS} as attributes")
    return rows.select("event_id", attributes.is_json_object(F.col("attributes")).alias("valid"))


_KIND = "CASE event_type WHEN 'click' THEN 'literal' WHEN 'view' THEN 'regex' WHEN 'error' THEN 'hash' ELSE event_type END"


@query(
    "enum_violations",
    f"""SELECT event_id, {_KIND} AS term_kind FROM events WHERE {_KIND} NOT IN ('literal', 'regex', 'ioc', 'hash')""",
)
def enum_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows outside a closed vocabulary."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{_KIND} as term_kind", "'allocated' as region")
    return quality.outside_domain(rows, "search_hits").select("event_id", "term_kind")


_STAGE = "CASE event_type WHEN 'click' THEN 'recover' WHEN 'error' THEN 'logs' ELSE event_type END"


@query(
    "stages_covered",
    f"""WITH s AS (SELECT DISTINCT {_STAGE} AS stage FROM events
      UNION SELECT 'filter' FROM labels WHERE toxic = 1 UNION SELECT 'search' FROM documents WHERE contains(text, 'AKIA')),
    k AS (SELECT stage FROM s WHERE stage IN ('recover', 'filter', 'logs', 'search'))
    SELECT 'filesystem inventory; MACB timeline; integrity verification'
      || CASE WHEN 'recover' IN (SELECT stage FROM k) THEN '; deleted/orphan-file recovery (data survival only)' ELSE '' END
      || CASE WHEN 'filter' IN (SELECT stage FROM k) THEN '; known-file filtering (NSRL/custom noise reduction)' ELSE '' END
      || CASE WHEN 'logs' IN (SELECT stage FROM k) THEN '; log analysis merged into the super-timeline' ELSE '' END
      || CASE WHEN 'search' IN (SELECT stage FROM k) THEN '; content search' ELSE '' END AS covered,
      CASE WHEN 'search' IN (SELECT stage FROM k) THEN '' ELSE 'content search' END AS excluded""",
)
def stages_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ran, recorded or evidenced by findings, as covered and excluded parts."""
    run_log = table(spark, sf_dir, "events").selectExpr(f"{_STAGE} as stage")
    findings = {
        "filter": table(spark, sf_dir, "labels").where("toxic = 1"),
        "search": table(spark, sf_dir, "documents").where("contains(text, 'AKIA')"),
    }
    statement = report.coverage_statement(report.stages_covered(run_log, findings))
    return statement.select(
        F.array_join("covered", "; ").alias("covered"), F.array_join("excluded", "; ").alias("excluded")
    )


_SOURCE = (
    "CASE WHEN value > 40 AND event_type = 'view' THEN 'filesystem:ext'"
    " WHEN value > 40 AND event_type = 'click' THEN 'filesystem' ELSE 'auth' END"
)


@query(
    "backfill_gate",
    f"""WITH e AS (SELECT user_id AS evidence_source_id, {_SOURCE} AS source FROM events)
    SELECT c_custkey AS evidence_source_id FROM customer
    WHERE c_custkey NOT IN (SELECT evidence_source_id FROM e WHERE starts_with(source, 'filesystem'))""",
)
def backfill_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that still lack filesystem events."""
    sources = table(spark, sf_dir, "customer").selectExpr("c_custkey as evidence_source_id")
    events = table(spark, sf_dir, "events").selectExpr("user_id as evidence_source_id", f"{_SOURCE} as source")
    done = events.where(F.startswith(F.col("source"), F.lit("filesystem")))
    return quality.only_new(sources, done, ["evidence_source_id"])
