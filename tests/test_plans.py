"""Plan shapes that decide how the operators scale."""

import re

from pyspark.sql import functions as F

from caseframe.operators import known, recovery, report, search, timeline
from caseframe.operators.logs import parse, years
from caseframe.plans.inventory_queries import normalized_files
from caseframe.plans.views import table, view


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(text, node):
    return len(re.findall(rf"^[ :+\-]*(?:\*\(\d+\) )?{node}\b", text, re.M))


def test_events_and_search_do_not_shuffle(spark, sf):
    assert count(plan(timeline.macb_events(normalized_files(spark, sf))), "Exchange") == 0
    docs = table(spark, sf, "documents").selectExpr("doc_id as file_id", "cast(text as binary) as content")
    found = plan(search.search_objects(docs, [(b"a", "ioc"), (b"bc", "literal")], [r"x\d+"]))
    assert count(found, "Exchange") == 0 and count(found, "Scan|FileScan") == 1


def scanned(df):
    """Columns of the only file scan."""
    text = re.search(r"FileScan parquet \[([^\]]*)\]", plan(df)).group(1)
    return {c.split("#")[0] for c in text.split(",")}


def test_only_the_needed_columns_are_read(spark, sf):
    events = timeline.macb_events(normalized_files(spark, sf)).select("ts_utc", "event_type")
    assert "l_shipdate" in scanned(events)
    assert not scanned(events) & {"l_extendedprice", "l_discount", "l_tax", "l_linestatus"}
    assert scanned(report.inventory_counts(view(spark, sf, "files_v"))) == {"doc_id"}


def test_the_head_grammar_is_matched_once(spark, sf):
    records = parse.parse(view(spark, sf, "loglines_v")).where("month(current_date()) > 0 and program is not null")
    text = records._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("[A-Z][a-z]{2}\\s+\\d{1,2}") == 1


def test_year_windows_share_one_sort_and_one_exchange_of_the_rows(spark):
    rows = spark.range(100).select(
        F.lit("k").alias("k"), F.col("id").alias("line_ord"), F.lit(0).alias("line_sub"), F.lit(3).alias("month"), F.lit("x").alias("payload")
    )
    seeds = spark.createDataFrame([("k", 2026)], "k string, seed_year int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(years.infer(rows, ["k"], ["line_ord", "line_sub"], seeds))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    carriers = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(carriers) <= 5
    assert sum("payload" in line and " Sort " in line for line in text.splitlines()) <= 1 or "payload" not in text


def test_patterns_over_chunks_never_gather_an_object(spark):
    """Below the few top rows, groups are stretches; the content is exchanged once, for the windows."""
    chunks = spark.createDataFrame([(1, 0, bytearray(b"ab"))], "object_id long, base long, data binary")
    text = plan(search.search_chunks(chunks, ["object_id"], regexes=[r"[^b]{3}"]))
    groups = re.findall(r"FlatMapGroupsInPandas \[([^\]]*)\]", text)
    assert len(groups) > 2 and sum("up#" not in g for g in groups) == 1
    dealt = re.findall(r"Exchange hashpartitioning\(([^\n]*)", text)
    assert all(d.startswith("_object") for d in dealt)
    content = [line for line in text.splitlines() if "Exchange" in line and "data#" in line]
    assert all("window_no" in line for line in content)


def test_term_lists_do_not_move_content(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("doc_id as file_id", "cast(text as binary) as content")
    terms = spark.createDataFrame([(bytearray(b"abc"), "ioc")], "term binary, kind string")
    assert count(plan(search.search_term_table(docs, terms)), "Exchange") == 0


def test_no_operator_is_a_cross_join(spark, sf):
    files = view(spark, sf, "files_v")
    lists = spark.createDataFrame([("l", "allow", "md5", "x")], "list_name string, sense string, algo string, hash string")
    docs = table(spark, sf, "documents").selectExpr("doc_id as file_id", "cast(text as binary) as content")
    terms = spark.createDataFrame([(bytearray(b"abc"), "ioc")], "term binary, kind string")
    nodes = view(spark, sf, "inodes_v").withColumn(
        "runs", F.array(F.struct(F.col("run_start").alias("start"), F.col("run_len").alias("len")))
    )
    for df in (
        known.match_lists(files, lists),
        search.search_term_table(docs, terms),
        recovery.block_overlap(nodes),
        recovery.unallocated(nodes.selectExpr("volume_id", "run_start as block_index"), nodes),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_a_hot_digest_is_split_when_nothing_can_be_broadcast(spark):
    hot = "f" * 32
    files = spark.range(0, 200000, 1, 8).select(
        F.lit(1).cast("long").alias("evidence_source_id"),
        F.col("id").alias("file_id"),
        F.when(F.col("id") % 3 == 0, hot).otherwise(F.md5(F.col("id").cast("string"))).alias("md5"),
        F.lit(None).cast("string").alias("sha1"),
        F.lit(None).cast("string").alias("sha256"),
    )
    lists = spark.range(50000).select(
        F.lit("l").alias("list_name"), F.lit("allow").alias("sense"), F.lit("md5").alias("algo"),
        F.when(F.col("id") == 0, hot).otherwise(F.md5(F.col("id").cast("string"))).alias("hash"),
    )
    settings = {
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = known.match_lists(files, lists)
        rows = out.collect()
        assert "skew=true" in plan(out)
    finally:
        for k in settings:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {i for i in range(200000) if i % 3 == 0 or 0 < i < 50000}
    assert len(rows) == len(want) and {r.file_id for r in rows} == want


def test_top_n_takes_before_sorting(spark, sf):
    events = timeline.macb_events(normalized_files(spark, sf))
    assert "TakeOrderedAndProject" in plan(timeline.first_n(events, 10))
