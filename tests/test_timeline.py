"""MACB events, the total order and the bounded read."""

import datetime

import pytest
from pyspark.sql import functions as F

from caseframe import schemas
from caseframe.functions import times
from caseframe.operators import ordered, quality, timeline

T = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def file_rows(spark, *rows):
    fields = schemas.FILES.fields
    out = []
    for kw in rows:
        base = {f.name: None for f in fields}
        base.update(evidence_source_id=1, file_id=1, volume_id=0, volume_offset=0, path="/a", name="a", attributes="{}")
        base.update(kw)
        out.append(tuple(base[f.name] for f in fields))
    return spark.createDataFrame(out, schemas.FILES)


def test_one_event_per_recorded_stamp(spark):
    df = timeline.macb_events(file_rows(spark, dict(mtime_utc=T, ctime_utc=T, crtime_utc=T, fs_type="ext", uid=0)))
    assert quality.schema_drift(df, schemas.TIMELINE_EVENTS) == []
    got = df.collect()
    assert sorted(r.event_type for r in got) == ["born", "changed", "modified"]
    assert {(r.source, r.actor) for r in got} == {("filesystem:ext", "uid=0")}


def test_actor_and_source_name_only_what_is_known(spark):
    got = timeline.macb_events(
        file_rows(spark, dict(mtime_utc=T), dict(mtime_utc=T, gid=4), dict(mtime_utc=T, uid=1, gid=2))
    ).collect()
    assert sorted((r.source, r.actor or "") for r in got) == [("filesystem", ""), ("filesystem", "gid=4"), ("filesystem", "uid=1,gid=2")]


def events(spark, rows):
    fields = schemas.TIMELINE_EVENTS.fields
    out = []
    for kw in rows:
        base = {f.name: None for f in fields}
        base.update(evidence_source_id=1, ts_utc=T, is_undated=False, source="auth", event_type="log", volume_id=0, volume_offset=0, path="/a", attributes="{}")
        base.update(kw)
        out.append(tuple(base[f.name] for f in fields))
    return spark.createDataFrame(out, schemas.TIMELINE_EVENTS)


def test_total_order_with_null_ties(spark):
    want = [
        dict(actor=None, meta_addr=None),
        dict(actor="user=a", meta_addr=None),
        dict(actor="user=a", meta_addr=None, line_ord=1),
        dict(actor="user=a", meta_addr=None, line_ord=2),
        dict(source="syslog", meta_addr=None),
        dict(meta_addr=3),
        dict(event_type="session"),
        dict(path="/b"),
        dict(volume_offset=512),
        dict(volume_id=1),
        dict(ts_utc=T + datetime.timedelta(microseconds=1)),
        dict(ts_utc=datetime.datetime(9999, 12, 31, 23, 59, 59, tzinfo=datetime.timezone.utc), is_undated=True),
    ]
    df = events(spark, [dict(w, outcome=str(i)) for i, w in enumerate(want)]).orderBy(F.rand(3))
    assert [int(r.outcome) for r in timeline.in_order(df).collect()] == list(range(len(want)))


def test_bounded_read_tells_the_total(spark):
    df = events(spark, [dict(path=f"/{i:03d}") for i in range(10)])
    got = timeline.first_n(df, 4).orderBy("position").collect()
    assert [(r.position, r.path, r.total, r.truncated) for r in got] == [(i + 1, f"/{i:03d}", 10, True) for i in range(4)]
    assert not timeline.first_n(df, 10).first().truncated


@pytest.mark.parametrize("rows", [(1, 1), (1, 7), (50, 50), (1000, 1000), ordered.RANGE_ROWS])
def test_ranges_by_day_keep_order_and_positions(spark, rows):
    """Most rows share one instant, some have none or one before 1970; every row is counted and placed once."""
    at = F.when(F.col("id") % 10 < 6, F.lit(T)).when(F.col("id") % 10 == 6, None).otherwise(F.timestamp_seconds((F.col("id") % 97 - 40) * 40_000))
    frame = spark.range(0, 400, 1, 5).select(
        at.alias("at"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("/é"), F.col("id") * 7919 % 101)).alias("path"), (F.col("id") % 3).alias("n"), "id"
    )
    order = ["at", "path", "n"]
    want = [tuple(r) for r in frame.orderBy(*order, "id").collect()]
    got = ordered.numbered_by_day(frame, [*order, "id"], rows).collect()
    assert [tuple(r) for r in got] == [(i, *w) for i, w in enumerate(want, 1)]
    tied = ordered.numbered_by_day(frame, order, rows).collect()
    assert [r.position for r in tied] == list(range(1, 401)) and [tuple(r)[1:4] for r in tied] == [w[:3] for w in want]
    assert ordered.numbered_by_day(frame.limit(0), order, rows).count() == 0


def test_order_samples_no_rows(spark):
    """A range sort evaluates every row a second time to sample it; days are counted from the instants alone."""
    plan = timeline.in_order(events(spark, [dict(path=f"/{i}") for i in range(9)]))._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_iso_text_is_looked_up(spark):
    """The formatter's text for every kind of instant, without its cost for each row."""
    micros = F.lit(-62167219200000000 - 86400000000 * 400) + F.col("id") * 106751991167 * 1000
    odd = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") * 7919 % 1000003)
    rows = spark.range(3000).select(F.when(F.col("id") != 7, F.timestamp_micros(micros + odd)).alias("ts"))
    fraction = F.when(F.unix_micros("ts") % 1000000 == 0, "").otherwise(F.concat(F.lit("."), F.lpad(F.pmod(F.unix_micros("ts"), F.lit(1000000)).cast("string"), 6, "0")))
    want = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))
    assert rows.where(~times.iso_utc(F.col("ts")).eqNullSafe(want)).count() == 0
    dated = spark.sql("select timestamp_seconds(id) as ts from range(9)").where("ts is not null").select(times.iso_utc(F.col("ts")).alias("t"))
    assert [r.t for r in dated.collect()][:2] == ["1970-01-01T00:00:00+00:00", "1970-01-01T00:00:01+00:00"]
