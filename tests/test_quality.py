"""Checks, manifests, digests, coverage and breakdowns."""

import pytest
from pyspark.sql import functions as F

from caseframe import schemas
from caseframe.operators import quality, report


def test_schema_drift_both_ways(spark):
    df = spark.createDataFrame([(1, "x", 2)], "case_id long, stage string, extra int")
    assert quality.schema_drift(df, schemas.RUN_LOG) == ["unexpected column extra"]
    with pytest.raises(quality.SchemaDrift, match="missing column stage"):
        quality.require_schema(df.select("case_id"), schemas.RUN_LOG)
    with pytest.raises(quality.SchemaDrift, match="is int, expected bigint"):
        quality.require_schema(df.select(F.col("case_id").cast("int"), "stage"), schemas.RUN_LOG)


def test_only_instants(spark):
    quality.require_utc(spark.sql("select current_timestamp() t"))
    with pytest.raises(quality.SchemaDrift):
        quality.require_utc(spark.sql("select timestamp_ntz'2024-01-01 00:00:00' t"))


def test_references_domains_attributes(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "file_id long")
    parent = spark.createDataFrame([(1,)], "file_id long")
    assert [r.file_id for r in quality.orphan_references(child, parent, ["file_id"]).collect()] == [2]
    hits = spark.createDataFrame([("allocated", "ioc"), ("slack", "ioc"), ("allocated", "glob")], "region string, term_kind string")
    assert quality.outside_domain(hits, "search_hits").count() == 2
    attrs = spark.createDataFrame([("{}",), ('{"a":[1]}',), ("[1]",), ("x",), ("3",), (None,)], "attributes string")
    assert [r[0] for r in quality.invalid_attributes(attrs).collect()] == ["[1]", "x", "3", None]


def test_manifest_outcomes(spark):
    m, s = "a" * 32, "b" * 64
    files = spark.createDataFrame([(p, m, s) for p in "abcdefg"], "path string, md5 string, sha256 string")
    manifest = spark.createDataFrame([("a", f" {m.upper()} "), ("b", s), ("c", "c" * 32), ("d", "b" * 40), ("e", "g" * 32), ("f", None)], "path string, supplied string")
    got = {r.path: (r.outcome, r.algorithm) for r in quality.verify_manifest(files, manifest).collect()}
    assert got == {
        "a": ("PASS", "md5"), "b": ("PASS", "sha256"), "c": ("FAIL", "md5"), "d": ("MALFORMED", None),
        "e": ("MALFORMED", None), "f": ("NOT_COMPARED", None), "g": ("NOT_COMPARED", None),
    }


def test_drift_between_manifests(spark):
    base = spark.createDataFrame([("a", "1", "1"), ("b", "1", "1"), ("c", None, None)], "path string, md5 string, sha256 string")
    now = spark.createDataFrame([("a", "1", "1"), ("b", "1", "2"), ("d", None, None)], "path string, md5 string, sha256 string")
    got = {r.path: r.drift for r in quality.manifest_drift(base, now).collect()}
    assert got == {"b": "changed", "c": "vanished", "d": "appeared"}


def test_digest_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "x").alias("v"))
    first = quality.result_digest(df.repartition(3)).first()
    assert first == quality.result_digest(df.repartition(17, "v")).first() and first.rows == 1000
    assert first != quality.result_digest(df.withColumn("v", F.lit("x"))).first()
    assert quality.result_digest(df.where("id < 0")).first().digest == "0"


def test_idempotent_append(spark):
    rows = spark.createDataFrame([(1, "logs"), (1, "search")], schemas.RUN_LOG)
    old = spark.createDataFrame([(1, "logs")], schemas.RUN_LOG)
    assert [r.stage for r in quality.only_new(rows, old, ["case_id", "stage"]).collect()] == ["search"]


def test_three_valued_allocation_and_recovered_rows(spark):
    rows = [(1, None, None, "reg", 0, 0, "ext"), (2, False, None, "dir", 0, 0, None), (3, False, True, "reg", 0, 0, "ntfs"), (4, True, False, "reg", 1, 5, None)]
    df = spark.createDataFrame(rows, "file_id long, allocated boolean, recovered boolean, meta_type string, volume_id long, volume_offset long, fs_type string")
    assert report.inventory_counts(df).first().asDict() == {"file_count": 3, "directory_count": 1, "deleted_count": 1}
    assert [tuple(r) for r in report.per_volume(df).collect()] == [(0, 0, "ext", 2, 1), (1, 5, None, 1, 0)]


def test_ranking_ties_by_label(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "source string")
    assert [tuple(r) for r in report.ranked(df, "source").collect()] == [("c", 2), ("a", 1), ("b", 1)]


def test_coverage_counts_a_stage_that_found_nothing(spark):
    log = spark.createDataFrame([(1, "search"), (1, "retired-stage")], schemas.RUN_LOG)
    empty = spark.createDataFrame([], "x int")
    full = spark.createDataFrame([(1,)], "x int")
    stages = report.stages_covered(log, {"filter": full, "logs": empty})
    assert [r.stage for r in stages.collect()] == ["filter", "search"]
    row = report.coverage_statement(stages).first()
    assert row.covered == [*report.ALWAYS_COVERED, *report.STAGE_COVERAGE["filter"], *report.STAGE_COVERAGE["search"]]
    assert row.excluded == ["deleted-file recovery", "log analysis", "super-timeline"]
    none = report.coverage_statement(report.stages_covered(log.where("false"), {})).first()
    assert none.covered == list(report.ALWAYS_COVERED) and len(none.excluded) == 5
