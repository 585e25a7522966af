"""Year inference against a step-by-step walk, with and without segment edges."""

import random

import pytest
from pyspark.sql import functions as F

from caseframe.operators.logs import years


def walk_back(dates, seed):
    """Independent check: newest to oldest with the earliest date seen as anchor."""
    out = [seed] * len(dates)
    anchor, year = dates[-1], seed
    for i in range(len(dates) - 2, -1, -1):
        here = dates[i]
        crosses = here > anchor and here[0] > 6 and anchor[0] < 7
        sustained = i == 0 or dates[i - 1][0] > 6 or here[0] > 10
        if crosses and sustained:
            year, anchor = year - 1, here
        else:
            anchor = min(anchor, here)
        out[i] = year
    return out


def inferred(spark, members, segment_rows):
    """members: {key: [(month, day) or None]} -> {key: [year]}"""
    rows = [
        (k, i, 0, d[0] if d else None) for k, dates in members.items() for i, d in enumerate(dates)
    ]
    df = spark.createDataFrame(rows, "k string, line_ord long, line_sub int, month int")
    seeds = spark.createDataFrame([(k, 2026) for k in members], "k string, seed_year int")
    out = years.infer(df, ["k"], ["line_ord", "line_sub"], seeds, segment_rows)
    got = {}
    for r in out.orderBy("k", "line_ord").collect():
        got.setdefault(r["k"], []).append(r["year"])
    return got


@pytest.mark.parametrize(
    "dates, expected",
    [
        ([(12, 20), (1, 5)], [2025, 2026]),
        ([(1, 2), (1, 20)], [2026, 2026]),
        ([(1, 20), (1, 2)], [2026, 2026]),
        ([(1, 2), (7, 9), (1, 5), (1, 8)], [2026, 2026, 2026, 2026]),
        ([(2, 1), (12, 30), (1, 3)], [2025, 2025, 2026]),
        ([(8, 1), (9, 1), (2, 1)], [2025, 2025, 2026]),
    ],
)
def test_known_cases(spark, dates, expected):
    assert inferred(spark, {"a": dates}, 1_000_000)["a"] == expected


@pytest.mark.parametrize("segment_rows", [1, 3, 7, 1000])
def test_random_members_equal_the_walk(spark, segment_rows):
    rng = random.Random(segment_rows)
    members = {}
    for k in range(150):
        n = rng.randint(1, 40)
        months = rng.choice([(1, 12), (1, 2, 7, 8, 11, 12), (6, 7), (1, 7, 10, 11)])
        members[f"m{k}"] = [
            None if rng.random() < 0.2 else (rng.choice(months), rng.randint(1, 28)) for _ in range(n)
        ]
    got = inferred(spark, members, segment_rows)
    for k, dates in members.items():
        datable = [d for d in dates if d]
        want = iter(walk_back(datable, 2026) if datable else [])
        assert got[k] == [next(want) if d else None for d in dates], (k, dates)


def test_one_long_member_is_spread_over_segments(spark):
    df = spark.range(5000).select(
        F.lit("only").alias("k"),
        F.col("id").alias("line_ord"),
        F.lit(0).alias("line_sub"),
        ((F.col("id") / 100).cast("int") % 12 + 1).alias("month"),
    )
    carry = years.segment_carry(df, ["k"], ["line_ord", "line_sub"], 500)
    assert carry.count() == 10
    seeds = spark.createDataFrame([("only", 2026)], "k string, seed_year int")
    got = [r.year for r in years.infer(df, ["k"], ["line_ord", "line_sub"], seeds, 500).orderBy("line_ord").collect()]
    assert got == walk_back([(int(i / 100) % 12 + 1, 1) for i in range(5000)], 2026)
