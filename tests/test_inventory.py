"""Inventory normalisation, timestamps, digests, types and names."""

import datetime
import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseframe import schemas
from caseframe.functions import attributes, names, signatures, times
from caseframe.operators import inventory, quality


def entry(**kw):
    base = {f.name: None for f in schemas.ENTRIES.fields}
    base.update(
        evidence_source_id=1, file_id=1, volume_id=0, volume_offset=0, name="a", path="/a", meta_addr=5,
        name_alloc=True, meta_alloc=True, meta_type_code=1, fs_type_code=8192, size=3,
        mtime=1000, atime=0, ctime=1000, crtime=0, mtime_nano=0, atime_nano=0, ctime_nano=0, crtime_nano=0,
        content=bytearray(b"abc"),
    )
    base.update(kw)
    return tuple(base[f.name] for f in schemas.ENTRIES.fields)


def files(spark, *entries, **kw):
    return inventory.normalize(spark.createDataFrame(list(entries), schemas.ENTRIES), **kw).orderBy("file_id").collect()


def test_schema_and_digests(spark):
    df = inventory.normalize(spark.createDataFrame([entry()], schemas.ENTRIES))
    assert quality.schema_drift(df, schemas.FILES) == []
    row = df.first()
    assert row.md5 == hashlib.md5(b"abc").hexdigest() and row.sha1 == hashlib.sha1(b"abc").hexdigest()
    assert row.sha256 == hashlib.sha256(b"abc").hexdigest()
    assert (row.fs_type, row.meta_type, row.allocated, row.timestamp_source) == ("ext", "reg", True, "ext4:inode")
    assert row.attributes == "{}" and row.recovered is None


def test_macb_zero_and_garbage_are_null(spark):
    row = files(spark, entry(mtime=1, mtime_nano=123456789, atime=253402300800, crtime=-62135596801))[0]
    assert row.mtime_utc == datetime.datetime(1970, 1, 1, 0, 0, 1, 123456)
    assert row.atime_utc is None and row.crtime_utc is None


def test_fat_is_local_time_and_flagged(spark):
    secs = int(datetime.datetime(2024, 7, 1, 12, 0, tzinfo=datetime.timezone.utc).timestamp())
    row = files(spark, entry(fs_type_code=4, mtime=secs), zone="America/New_York")[0]
    assert row.mtime_utc == datetime.datetime(2024, 7, 1, 16, 0)
    assert row.attributes == '{"assumed_timezone":"America/New_York","time_precision":"local-time-inferred"}'
    same = files(spark, entry(mtime=secs), zone="America/New_York")[0]
    assert same.mtime_utc == datetime.datetime(2024, 7, 1, 12, 0)


def test_entries_without_an_inode(spark):
    row = files(spark, entry(meta_addr=None, meta_alloc=None, meta_type_code=None, name_type_code=5, uid=None))[0]
    assert row.mtime_utc is None and row.timestamp_source is None and row.allocated is False and row.uid is None
    assert row.meta_type == "reg"


def test_labels(spark):
    got = files(
        spark,
        entry(file_id=1, meta_type_code=2, fs_type_code=1),
        entry(file_id=2, meta_type_code=0, name_type_code=6, fs_type_code=128),
        entry(file_id=3, meta_type_code=None, name_type_code=None, fs_type_code=99),
    )
    assert [(r.meta_type, r.fs_type, r.file_type) for r in got] == [
        ("dir", "ntfs", "directory"), ("lnk", "ext", "symlink"), ("unknown", "unknown", None),
    ]
    assert all(r.md5 is None for r in got)


def test_digest_skip_reasons(spark):
    got = files(
        spark,
        entry(file_id=1, size=9),
        entry(file_id=2, content=None),
        entry(file_id=3, size=100, content=bytearray(b"x" * 100)),
        entry(file_id=4, size=0, content=None),
        entry(file_id=5, meta_alloc=False),
        max_hash_size=50,
    )
    skip = [("hash_skipped\":\"" in r.attributes) and r.attributes.split('hash_skipped":"')[1].split('"')[0] for r in got]
    assert skip == ["short_read", "read_error", "exceeds_max_hash_size", False, False]
    assert [r.md5 is None for r in got] == [True, True, True, False, True]
    assert got[3].md5 == hashlib.md5(b"").hexdigest() and got[3].file_type == "inode/x-empty"
    assert "unallocated-blocks-may-be-reused" in got[4].attributes and got[4].file_type == "text/plain"
    assert got[1].file_type is None


def test_a_user_typer_replaces_the_default(spark):
    @F.pandas_udf("string")
    def by_length(content: pd.Series) -> pd.Series:
        return content.map(lambda b: f"len/{len(b)}")

    assert files(spark, entry(), typer=by_length)[0].file_type == "len/3"


@pytest.mark.parametrize(
    "data, want",
    [
        (b"\x89PNG\r\n\x1a\n..", "image/png"),
        (b"%PDF-1.7", "application/pdf"),
        (b"\x1f\x8b\x08", "application/gzip"),
        (b"\x00" * 257 + b"ustar", "application/x-tar"),
        (b"<!DOCTYPE html><html>", "text/html"),
        (b"plain words \xc3\xa9\n", "text/plain"),
        (b"a\x00b", "application/octet-stream"),
        (b"x" * 4096 + b"\x00", "text/plain"),
        (b"", "inode/x-empty"),
        (None, None),
    ],
)
def test_file_type(spark, data, want):
    df = spark.createDataFrame([(bytearray(data) if data is not None else None,)], "b binary")
    assert df.select(signatures.file_type(F.col("b"))).first()[0] == want


def test_unreadable_volumes_become_limitations(spark):
    rows = [
        (1, 0, 0, "Linux", None, bytearray(b"")),
        (1, 1, 512, "crypt", "cannot open", bytearray(b"LUKS\xba\xbe\x00\x01")),
        (1, 2, 1024, "win", "cannot open", bytearray(b"\xeb\x58\x90-FVE-FS-\x00")),
        (1, 3, 2048, "odd", "cannot open", None),
        (1, 4, 4096, "late", "cannot open", bytearray(b"x" * 16 + b"-FVE-FS-")),
    ]
    df = spark.createDataFrame(rows, "evidence_source_id long, volume_id long, volume_offset long, description string, error string, head binary")
    ok, limits = inventory.split_volumes(df)
    assert [r.volume_id for r in ok.collect()] == [0]
    assert quality.schema_drift(limits, schemas.VOLUME_LIMITATIONS) == []
    got = {r.volume_id: r.attributes for r in limits.collect()}
    assert got == {1: '{"encryption_hint":"likely LUKS"}', 2: '{"encryption_hint":"likely BitLocker"}', 3: "{}", 4: "{}"}


@pytest.mark.parametrize(
    "name, safe, confined",
    [
        ("../../etc/passwd", "etc/passwd", False),
        ("/abs/olute", "abs/olute", False),
        ("C:\\win\\..\\x", "C_/win/x", False),
        ("a\x00b\x1fc", "a_b_c", True),
        ("naïve name.txt", "naïve name.txt", True),
        ("a\u2028b\u00a0c", "a_b_c", True),
        (" x /.", "x", True),
        ("...", "...", True),
        ("..", "", False),
    ],
)
def test_sanitize(spark, name, safe, confined):
    df = spark.createDataFrame([(name,)], "n string")
    got = df.select(names.sanitize(F.col("n")).alias("s"), names.is_confined(F.col("n")).alias("c")).first()
    assert (got.s, got.c) == (safe, confined)


def test_recovered_names_stay_under_their_folder(spark):
    hostile = ["../../../x", "", "..", "/etc/passwd", "a\x1b[31m"]
    df = spark.createDataFrame([(h,) for h in hostile], "n string")
    got = [r[0] for r in df.select(names.recovered_path(F.lit(1), F.lit(512), F.lit(12), F.col("n"))).collect()]
    assert all(p.startswith("recovered/vol1-off512/12-") and ".." not in p.split("/") for p in got)
    assert got[1] == got[2] == "recovered/vol1-off512/12-unnamed"


def test_iso_text(spark):
    df = spark.sql("select timestamp_micros(u) t from values (0L), (1500000L), (-1L), (-62135596800000000L) v(u)")
    got = [r[0] for r in df.select(times.iso_utc(F.col("t"))).collect()]
    assert got == [
        "1970-01-01T00:00:00+00:00", "1970-01-01T00:00:01.500000+00:00",
        "1969-12-31T23:59:59.999999+00:00", "0001-01-01T00:00:00+00:00",
    ]


def test_flags_keep_their_types_and_sort_keys(spark):
    row = spark.range(1).select(
        attributes.flags_json(b=F.lit(2), a=F.lit("x"), z=F.lit(None).cast("string"), t=F.lit(True), n=F.array(F.lit(3), F.lit(4))).alias("j"),
    ).first()
    assert row.j == '{"a":"x","b":2,"n":[3,4],"t":true}'
