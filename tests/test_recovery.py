"""Overlap, tiers, orphans and deleted-inode discovery."""

import hashlib
import random

import pytest

from caseframe import schemas
from caseframe.operators import quality, recovery


def inodes(spark, rows):
    """rows: dicts over the inode columns."""
    out = []
    for kw in rows:
        base = dict(volume_id=0, volume_offset=0, meta_addr=1, size=1, meta_type="reg", allocated=False, orphan_flag=False, now_allocated=False, has_resident_data=False, runs=[])
        base.update(kw)
        out.append(tuple(base[f.name] for f in schemas.INODES.fields))
    return spark.createDataFrame(out, schemas.INODES)


@pytest.mark.parametrize("bucket", [1, 4, 16, 1024])
def test_overlap_equals_block_sets(spark, bucket):
    rng = random.Random(bucket)
    rows = []
    for addr in range(120):
        runs = [(rng.randrange(300), rng.choice([0, 1, 2, 9, 60])) for _ in range(rng.randrange(4))]
        rows.append(dict(meta_addr=addr, volume_id=addr % 2, allocated=rng.random() < 0.4, runs=runs))
    blocks = lambda r: {b for s, n in r["runs"] for b in range(s, s + n)}
    want = {}
    for r in rows:
        if not r["allocated"]:
            taken = set().union(*[blocks(o) for o in rows if o["allocated"] and o["volume_id"] == r["volume_id"]])
            shared = sorted(blocks(r) & taken)
            if shared:
                want[r["meta_addr"]] = (len(shared), shared[:32])
    got = {r.meta_addr: (r.n_shared, r.overlapping_blocks) for r in recovery.block_overlap(inodes(spark, rows), bucket).collect()}
    assert got == want


def test_allocated_side_of_a_bucket_is_one_interval_per_stretch(spark):
    rows = [dict(meta_addr=i, allocated=True, runs=[(i % 7, 3)]) for i in range(3000)]
    got = recovery.allocated_intervals(inodes(spark, rows), 1024).collect()
    assert [(r.lo, r.hi) for r in got] == [(0, 9)]


def test_tiers(spark):
    rows = [
        dict(meta_addr=1, allocated=True, runs=[(100, 3)]),
        dict(meta_addr=10, runs=[(5, 2)]),
        dict(meta_addr=11, runs=[(101, 1)]),
        dict(meta_addr=12, size=42),
        dict(meta_addr=13, size=20, has_resident_data=True),
        dict(meta_addr=14, size=0),
        dict(meta_addr=15, runs=[(5, 2)], now_allocated=True),
    ]
    got = {r.meta_addr: (r.confidence_tier, r.tier_reason, r.overlapping_blocks) for r in recovery.with_tier(inodes(spark, rows), 64).collect()}
    assert got == {
        10: ("intact", recovery.REASON_INTACT, None),
        11: ("partial/overwritten", recovery.REASON_OVERLAP, [101]),
        12: ("partial/overwritten", recovery.REASON_NO_RUNS, None),
        13: ("intact", recovery.REASON_RESIDENT, None),
        14: ("intact", recovery.REASON_INTACT, None),
        15: ("partial/overwritten", recovery.REASON_REALLOCATED, None),
    }


def test_single_blocks_are_runs(spark):
    df = spark.createDataFrame([(0, 1, True, [4, 9])], "volume_id long, meta_addr long, allocated boolean, data_blocks array<long>")
    got = sorted((r.lo, r.hi) for r in recovery.allocated_intervals(recovery.runs_of_blocks(df)).collect())
    assert got == [(4, 5), (9, 10)]


def entries(spark, rows):
    schema = "volume_id long, volume_offset long, meta_addr long, name string, path string, parent_addr long, allocated boolean, meta_type string, entry_ordinal long"
    return spark.createDataFrame(rows, schema)


def test_deleted_discovery_and_orphans(spark):
    nodes = inodes(
        spark,
        [
            dict(meta_addr=2, allocated=True, meta_type="dir"),
            dict(meta_addr=13),
            dict(meta_addr=14),
            dict(meta_addr=15, orphan_flag=True),
            dict(meta_addr=16, size=9),
            dict(meta_addr=17, size=0),
            dict(meta_addr=18, meta_type="dir", size=5),
        ],
    )
    links = entries(
        spark,
        [
            (0, 0, 13, "late", "/late", 2, False, "reg", 9),
            (0, 0, 13, "first", "/first", 2, False, "reg", 1),
            (0, 0, 14, "gone", "/x/gone", 99, False, "reg", 2),
            (0, 0, 15, "flag", "/flag", 2, False, "reg", 3),
            (0, 0, 2, "dir", "/dir", 2, True, "dir", 4),
            (0, 0, None, "nometa", "/nometa", 2, False, "reg", 5),
        ],
    )
    found = recovery.deleted_inodes(links, nodes)
    got = {r.meta_addr: (r.path, r.is_orphan, r.found_by) for r in found.collect()}
    assert got == {
        13: ("/first", False, "directory"),
        14: ("/x/gone", True, "directory"),
        15: ("/flag", True, "directory"),
        16: ("/$OrphanFiles/16", True, "scan"),
    }
    contents = spark.createDataFrame([(0, 13, bytearray(b"z")), (0, 16, bytearray(b"short"))], "volume_id long, meta_addr long, content binary")
    rows = recovery.recovered_rows(found, recovery.with_tier(nodes), 3, contents)
    assert quality.schema_drift(rows, schemas.FILES) == []
    by_addr = {r.meta_addr: r for r in rows.collect()}
    assert by_addr[13].md5 == hashlib.md5(b"z").hexdigest() and by_addr[13].recovered and by_addr[13].file_id < 0
    assert by_addr[13].recovered_path == "recovered/vol0-off0/13-first"
    assert by_addr[16].md5 is None and '"hash_skipped":"short_read"' in by_addr[16].attributes
    assert by_addr[16].name == "inode-16" and by_addr[14].file_type is None


def test_names_of_reallocated_and_missing_inodes_stay(spark):
    nodes = inodes(spark, [dict(meta_addr=2, allocated=True, meta_type="dir"), dict(meta_addr=30, allocated=True, size=7), dict(meta_addr=31)])
    links = entries(spark, [(0, 0, 30, "old", "/old", 2, False, "reg", 1), (0, 0, 99, "lost", "/lost", 2, False, "reg", 2), (0, 0, 31, "x", "/x", 2, False, "reg", 3)])
    found = recovery.deleted_inodes(links, nodes)
    rows = recovery.recovered_rows(found, recovery.with_tier(nodes, live=True), 1)
    got = {r.meta_addr: (r.confidence_tier, recovery.REASON_REALLOCATED in r.attributes) for r in rows.collect()}
    assert got[30] == ("partial/overwritten", True) and got[99] == ("partial/overwritten", False) and got[31][1] is False
    lost = rows.where("meta_addr = 99").first()
    assert lost.meta_type == "unknown" and recovery.REASON_NO_INODE in lost.attributes


@pytest.mark.parametrize("bucket", [2, 8, 1024])
def test_free_runs_are_the_complement(spark, bucket):
    rng = random.Random(bucket)
    rows = [
        dict(meta_addr=k, volume_id=k % 3, allocated=k % 4 != 0, runs=[(rng.randrange(400), rng.choice([0, 1, 3, 40])) for _ in range(3)])
        for k in range(24)
    ]
    nodes = inodes(spark, rows)
    volumes = spark.createDataFrame([(0, 7, 500), (1, 7, 300), (2, 7, 0), (9, 7, 12)], "volume_id long, volume_offset long, block_count long")
    want = set()
    for v, n in ((0, 500), (1, 300), (9, 12)):
        taken = {b for r in rows if r["allocated"] and r["volume_id"] == v for s, k in r["runs"] for b in range(s, s + k)}
        free = [b for b in range(n) if b not in taken]
        for b in free:
            if b - 1 not in free:
                end = b
                while end + 1 in free:
                    end += 1
                want.add((v, 7, b, end - b + 1))
    got = recovery.unallocated_runs(volumes, nodes, bucket).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    every = recovery.unallocated(recovery.block_numbers(volumes), nodes, bucket).collect()
    assert sorted((r.volume_id, r.block_index) for r in every) == sorted((v, b) for v, _, s, n in want for b in range(s, s + n))


def test_unallocated_complement(spark):
    nodes = inodes(spark, [dict(meta_addr=1, allocated=True, runs=[(2, 3), (3, 4)]), dict(meta_addr=2, runs=[(0, 2)])])
    volumes = spark.createDataFrame([(0, 0, 10)], "volume_id long, volume_offset long, block_count long")
    free = recovery.unallocated(recovery.block_numbers(volumes, step=3), nodes)
    assert sorted(r.block_index for r in free.collect()) == [0, 1, 7, 8, 9]


def test_free_blocks_by_words(spark):
    """Runs over word edges, full words, runs that overlap, and none; places below zero and none belong to nobody."""
    runs = {1: [(0, 64), (60, 10), (127, 2), (192, 64)], 2: [(5, 1), (63, 130), (400, 0)], 3: []}
    rows = [(v, i, True, [run]) for v, some in runs.items() for i, run in enumerate(some)] + [(3, 9, False, [(0, 500)])]
    nodes = spark.createDataFrame(rows, "volume_id long, meta_addr long, allocated boolean, runs array<struct<start:long,len:long>>")
    blocks = spark.createDataFrame([(v, b) for v in runs for b in [None, -1, *range(300)]], "volume_id long, block_index long")
    owned = {(v, b) for v, some in runs.items() for start, n in some for b in range(start, start + n)}
    want = sorted((v, str(b)) for v in runs for b in [None, -1, *range(300)] if (v, b) not in owned)
    for bucket in (3, 64, 1024):
        free = recovery.unallocated(blocks, nodes, bucket)
        assert sorted((r.volume_id, str(r.block_index)) for r in free.collect()) == want
    joins = recovery.unallocated(blocks, nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in joins  # a block is not compared with the intervals of its neighbours
