"""Every registered query against its SQL equivalent, and stable under repartitioning."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import check_queries  # noqa: E402

import __spark_entry__ as driver  # noqa: E402
from caseframe.operators import quality  # noqa: E402
from caseframe.plans import catalog  # noqa: E402

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck(sf):
    return check_queries.connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, sf, name):
    line = check_queries.compare(spark, duck, name, sf)
    assert line.split(f"{name}: ", 1)[1] == "ok", line


def test_every_query_has_sql():
    assert set(catalog.oracle_sql()) == set(NAMES)


def test_entry(spark):
    df = driver.entry(spark)
    assert df.limit(1).count() == 1 and "ts_utc" in df.columns


@pytest.mark.parametrize("name", ["infer_years", "known_match", "search_chunked", "block_overlap", "log_resolve_time"])
def test_digest_is_the_same_for_any_partitioning(spark, sf, name):
    digests = set()
    for partitions, split in (("3", "20000"), ("11", "134217728")):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        digests.add(quality.result_digest(catalog.queries()[name](spark, sf)).first())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(digests) == 1
