"""Report breakdowns. Every count is a partial aggregation; ties rank by label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.schemas import ENUMS

# What every report covers, and what each stage adds.
ALWAYS_COVERED = ("filesystem inventory", "MACB timeline", "integrity verification")
STAGE_COVERAGE = {
    "recover": ("deleted/orphan-file recovery (data survival only)",),
    "filter": ("known-file filtering (NSRL/custom noise reduction)",),
    "logs": ("log analysis merged into the super-timeline",),
    "search": ("content search",),
}
STAGE_EXCLUSION = {
    "recover": ("deleted-file recovery",),
    "filter": ("known-file (NSRL) filtering",),
    "logs": ("log analysis", "super-timeline"),
    "search": ("content search",),
}
PROVENANCE = ("time_precision", "assumed_timezone", "file_type_provenance")


def header(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """The case and the evidence that a report is about; no wall clock."""
    named = cases.select("case_id", F.col("name").alias("case_name"), "examiner", "notes")
    chosen = evidence.select("case_id", "evidence_source_id", "evidence_id", F.col("path").alias("acquisition_source"), "image_type")
    return chosen.join(named, "case_id").orderBy("evidence_source_id")


def integrity(checks: DataFrame) -> DataFrame:
    """One row: was anything supplied to compare with, did all of it match, did a re-verification find a change.

    Nothing supplied is no match: ``acquisition_compare_pass`` needs a digest
    that was given and that agrees.
    """
    acquired, again = F.col("check") == "acquisition", F.col("check") == "reverify"
    given = acquired & (F.col("outcome") != "NOT_COMPARED")
    counts = checks.agg(
        F.count_if(given).alias("compared"),
        F.count_if(acquired & (F.col("outcome") == "NOT_COMPARED")).alias("not_compared"),
        F.count_if(acquired & (F.col("outcome") == "FAIL")).alias("mismatches"),
        F.count_if(acquired & (F.col("outcome") == "MALFORMED")).alias("malformed"),
        F.count_if(again).alias("drifted"),
    )
    failed = F.col("mismatches") + F.col("malformed")
    return counts.withColumns(
        {
            "acquisition_supplied": F.col("compared") > 0,
            "acquisition_compare_pass": (F.col("compared") > 0) & (failed == 0),
            "reverify_pass": F.col("drifted") == 0,
            "passed": (failed == 0) & (F.col("drifted") == 0),
        }
    )


def inventory_rows(files: DataFrame) -> DataFrame:
    """Without recovered rows, which repeat a deleted inode of the inventory."""
    return files.where("recovered is not true")


def _deleted():
    return F.count_if(F.col("allocated").eqNullSafe(F.lit(False)))


def inventory_counts(files: DataFrame) -> DataFrame:
    return inventory_rows(files).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.count_if(F.col("meta_type") == "dir").alias("directory_count"),
        _deleted().alias("deleted_count"),
    )


def per_volume(files: DataFrame) -> DataFrame:
    """Counts per volume; the first non-null file-system type in file order."""
    return (
        inventory_rows(files)
        .groupBy("volume_id", "volume_offset")
        .agg(
            F.min_by("fs_type", F.when(F.col("fs_type").isNotNull(), F.col("file_id"))).alias("fs_type"),
            F.count(F.lit(1)).alias("file_count"),
            _deleted().alias("deleted_count"),
        )
        .orderBy("volume_id", "volume_offset")
    )


def walk_counts(files: DataFrame, limitations: DataFrame) -> DataFrame:
    limits = limitations.agg(F.count(F.lit(1)))
    return inventory_rows(files).agg(
        F.count(F.lit(1)).alias("files_inventoried"),
        _deleted().alias("deleted_count"),
        F.count_distinct("volume_id", "volume_offset").alias("volumes_walked"),
    ).withColumn("limitations_recorded", limits.scalar())


def ranked(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Counts per value, most frequent first, ties by value."""
    out = name or column
    return (
        df.groupBy(F.col(column).alias(out))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc(out))
    )


def file_type_distribution(files: DataFrame) -> DataFrame:
    return ranked(inventory_rows(files).where("file_type is not null"), "file_type")


def provenance_flags(files: DataFrame) -> DataFrame:
    """Distinct sets of the surfaced flags, read from the attributes."""
    picked = files.select(
        *[F.get_json_object("attributes", f"$.{k}").alias(k) for k in PROVENANCE]
    ).where(" or ".join(f"{k} is not null" for k in PROVENANCE))
    return picked.distinct().orderBy(*PROVENANCE)


def log_events(events: DataFrame) -> DataFrame:
    return events.where(~F.startswith(F.col("source"), F.lit("filesystem")))


def log_by_source(events: DataFrame) -> DataFrame:
    return ranked(log_events(events), "source")


def log_inferred_counts(events: DataFrame) -> DataFrame:
    def present(key: str):
        return F.count_if(F.get_json_object("attributes", f"$.{key}").isNotNull())

    return log_events(events).agg(
        present("year_inferred").alias("inferred_year_count"),
        present("assumed_timezone").alias("inferred_timezone_count"),
    )


def log_run_counts(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Events parsed, auth events, sets (one completeness finding each), findings."""
    per_finding = findings.agg(
        F.count_if(F.col("category") == "completeness").alias("s"), F.count(F.lit(1)).alias("n")
    )
    return (
        log_events(events)
        .agg(
            F.count(F.lit(1)).alias("events_parsed"),
            F.count_if(F.col("source") == "auth").alias("auth_events"),
        )
        .withColumn("log_sets", per_finding.select("s").scalar())
        .withColumn("findings_count", per_finding.select("n").scalar())
    )


def search_by_region_kind(hits: DataFrame) -> DataFrame:
    """Counts by region and counts by kind in one aggregation over the hits."""
    grouped = hits.groupBy("region", "term_kind").agg(F.count(F.lit(1)).alias("n"))
    labelled = grouped.select(
        "n",
        F.explode(
            F.array(
                F.struct(F.lit("region").alias("breakdown"), F.col("region").alias("label")),
                F.struct(F.lit("term_kind").alias("breakdown"), F.col("term_kind").alias("label")),
            )
        ).alias("e"),
    )
    return (
        labelled.groupBy("e.breakdown", "e.label")
        .agg(F.sum("n").alias("count"))
        .orderBy("breakdown", F.desc("count"), "label")
    )


def search_run_counts(hits: DataFrame) -> DataFrame:
    return hits.agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_if(F.col("region") == "unallocated").alias("unallocated_hits"),
        F.count_if(F.col("term_kind") == "hash").alias("hash_hits"),
    )


def nsrl_by_column(matches: DataFrame) -> DataFrame:
    return ranked(matches.where("source = 'nsrl'"), "matched_on", "hash")


def custom_by_list(matches: DataFrame) -> DataFrame:
    return (
        matches.where("source = 'custom'")
        .groupBy(
            F.coalesce("list_name", F.lit("")).alias("list_name"),
            F.coalesce("sense", F.lit("")).alias("sense"),
        )
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("list_name", "sense")
    )


def known_files_distinct(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count_distinct("file_id").alias("files_matched"))


def recovery_counts(files: DataFrame) -> DataFrame:
    rows = files.where("recovered")
    return rows.agg(
        F.count(F.lit(1)).alias("files_recovered"),
        F.count_if(F.col("confidence_tier") == "intact").alias("intact_count"),
        F.count_if(F.col("confidence_tier") == "partial/overwritten").alias("overwritten_count"),
        F.count_if(F.coalesce(F.col("is_orphan"), F.lit(False))).alias("orphan_count"),
    )


def recovered_files(files: DataFrame) -> DataFrame:
    return files.where("recovered and not coalesce(is_orphan, false)")


def orphan_files(files: DataFrame) -> DataFrame:
    return files.where("recovered and is_orphan")


def stages_covered(run_log: DataFrame, findings: dict[str, DataFrame]) -> DataFrame:
    """Stages that ran: recorded ones and ones whose findings exist.

    ``findings`` maps a stage to a table with its rows; one row of it is enough.
    """
    known = ENUMS["run_log"]["stage"]
    stages = run_log.where(F.col("stage").isin(*known)).select("stage")
    for stage, rows in findings.items():
        stages = stages.unionByName(rows.limit(1).select(F.lit(stage).alias("stage")))
    return stages.distinct().orderBy("stage")


def coverage_statement(stages: DataFrame) -> DataFrame:
    """Two arrays: what the report covers and what it does not."""
    ran = stages.agg(F.collect_set("stage").alias("ran"))
    covered = [F.array(*[F.lit(t) for t in ALWAYS_COVERED])]
    excluded = []
    empty = F.array().cast("array<string>")
    for stage in STAGE_COVERAGE:
        has = F.array_contains("ran", stage)
        covered.append(F.when(has, F.array(*[F.lit(t) for t in STAGE_COVERAGE[stage]])).otherwise(empty))
        excluded.append(F.when(has, empty).otherwise(F.array(*[F.lit(t) for t in STAGE_EXCLUSION[stage]])))
    return ran.select(F.concat(*covered).alias("covered"), F.concat(*excluded).alias("excluded"))


def has_source_prefix(events: DataFrame, prefix: str) -> bool:
    """Whether any event has a source with the prefix; stops at the first."""
    return not events.where(F.startswith(F.col("source"), F.lit(prefix))).limit(1).isEmpty()
