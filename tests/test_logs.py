"""Log parsing, discovery and time resolution on small literal cases."""

import datetime
import gzip
import random

import pytest
from pyspark.sql import functions as F

from caseframe.operators.logs import discover, parse, resolve
from caseframe.sources import text

UTC = datetime.timezone.utc


def lines(spark, path, body, volume_id=0):
    rows = [(volume_id, path, i, 0, line) for i, line in enumerate(body)]
    return spark.createDataFrame(rows, "volume_id long, path string, line_ord long, line_sub int, line string")


def records(spark, path, body):
    return parse.parse(lines(spark, path, body)).orderBy("line_ord").collect()


def test_head_fields(spark):
    got = records(spark, "/var/log/auth.log", ["Jan 15 03:14:15 box sudo[77]: pam: authentication failure; user=eve"])[0]
    assert (got.program, got.host, got.pid, got.raw_timestamp) == ("sudo", "box", "77", "Jan 15 03:14:15")
    assert (got.action, got.outcome, got.actor) == ("sudo", "denied", "user=eve")


@pytest.mark.parametrize(
    "message, want",
    [
        ("Accepted publickey for amy from 10.0.0.1 port 1", ("ssh-login", "success", "user=amy")),
        ("Failed password for invalid user bob from 10.0.0.1", ("ssh-login", "failure", "user=bob")),
        ("pam_unix(sudo:session): session opened for user root", ("session", "opened", "user=root")),
        ("pam_unix(sshd:session): session closed for user amy", ("session", "closed", "user=amy")),
        ("amy : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls", ("sudo", "granted", "user=amy")),
        ("new user: name=zed, UID=1001", ("account", "created", None)),
        ("something else user=zed", (None, None, "user=zed")),
        ("nothing known", (None, None, None)),
    ],
)
def test_auth_taxonomy(spark, message, want):
    got = records(spark, "/x/auth.log", [f"Mar  3 01:02:03 h p: {message}"])[0]
    assert (got.action, got.outcome, got.actor) == want


def test_syslog_taxonomy_and_unmatched_lines(spark):
    got = records(
        spark,
        "/var/log/syslog.1",
        [
            "Jan 15 03:14:15 h kernel: usb 1-1: new device",
            "Jan 15 03:14:16 h CRON[9]: (root) CMD (true)",
            "Jan 15 03:14:17 h nginx[3]: connect() FAILED: critical",
            "  ",
            "no head at all: error",
            "<34>1 2026-05-31T12:00:00.000+02:00 h app - ID47 [x@1 a=\"b\"] it broke: fatal",
        ],
    )
    assert [(r.action, r.outcome) for r in got] == [
        ("kernel", None),
        ("cron", None),
        ("service", "error"),
        (None, None),
        ("service", "error"),
    ]
    assert got[3].message == "no head at all: error" and got[3].program is None
    assert got[4].is_rfc5424 and got[4].pid is None and got[4].message == "it broke: fatal"


def test_bash_markers_and_zsh_lines(spark):
    got = records(
        spark,
        "/home/amy/.bash_history",
        ["ls", "cd /", "#1736899200", "", "cat x", "history -c", "#1736899300", "#1736899400", "id", "#1736899500", ": 1736899600:0;who", "pwd"],
    )
    assert [(r.message, r.epoch) for r in got] == [
        ("ls", None),
        ("cd /", None),
        ("cat x", 1736899200),
        ("history -c", None),
        ("id", 1736899400),
        ("who", 1736899600),
        ("pwd", None),
    ]
    assert {r.actor for r in got} == {"user=amy"}
    assert got[0].ts_basis == "file-mtime-fallback; no per-line timestamp" and got[2].ts_basis is None


def test_root_history_has_no_actor(spark):
    assert records(spark, "/root/.zsh_history", [": 1736899300:0;whoami"])[0].actor is None


@pytest.mark.parametrize(
    "leaf, want",
    [
        ("auth.log", "auth"),
        ("auth.log.2.gz", "auth"),
        ("secure", "auth"),
        ("secure.1", "auth"),
        ("syslog", "syslog"),
        ("messages.3", "syslog"),
        (".bash_history", "shell-history"),
        (".zsh_history", "shell-history"),
        ("dpkg.log", None),
    ],
)
def test_routing(spark, leaf, want):
    row = spark.createDataFrame([(f"/a/{leaf}",)], "path string")
    assert row.select(parse.route(F.col("path"))).first()[0] == want


def member_rows(spark, paths):
    rows = [(1, 0, p) for p in paths]
    return discover.members(spark.createDataFrame(rows, "evidence_source_id long, volume_id long, path string"))


def test_rotation_order_and_completeness(spark):
    paths = ["/v/auth.log", "/v/auth.log.4.gz", "/v/auth.log.1", "/v/auth.log.1.gz", "/v/auth.log-20240102", "/v/auth.log.20240101.gz", "/w/auth.log.2", "/v/authx", "/h/.bash_history"]
    rows = member_rows(spark, paths)
    order = [r.path for r in discover.with_rotation_position(rows).where("set_key = '/v/auth.log'").orderBy("position").collect()]
    assert order == ["/v/auth.log.4.gz", "/v/auth.log.1.gz", "/v/auth.log.1", "/v/auth.log.20240101.gz", "/v/auth.log-20240102", "/v/auth.log"]
    got = {r.set_key: r for r in discover.completeness(rows).collect()}
    assert got["/v/auth.log"].present_indices == [0, 1, 4] and got["/v/auth.log"].missing_indices == [2, 3]
    assert got["/v/auth.log"].member_count == 6
    assert got["/v/auth.log"].note.endswith("rotation indices [2, 3] absent (rotated out / never present)")
    assert got["/w/auth.log"].missing_indices == [0, 1]
    assert got["/h/.bash_history"].note == discover.NOTE_HISTORY
    kinds = [r.category for r in discover.disclosures(rows).collect()]
    assert sorted(kinds) == ["completeness"] * 3 + ["tamperability"]


def resolve_one(spark, path, body, mtime, zone, strict=False, newest=0):
    found = member_rows(spark, [path])
    stamps = spark.createDataFrame([(0, path, mtime), (0, "/other", newest)], "volume_id long, path string, mtime long")
    members = resolve.seed_years(found, stamps).select(
        "evidence_source_id", "volume_id", "path", F.lit(0).cast("long").alias("volume_offset"),
        F.lit(7).cast("long").alias("file_id"), "seed_year", "seed_basis", "seed_unresolved",
        F.lit(zone).cast("string").alias("zone"), F.lit("etc-localtime" if zone else "tz-undeterminable").alias("tz_resolution"),
    )
    out = resolve.resolve(parse.parse(lines(spark, path, body)), members, strict)
    return [r.asDict() for r in out.orderBy("line_ord").collect()]


def stamp(y, *rest):
    return datetime.datetime(y, *rest)


JAN_2024 = 1704171600


def test_head_in_host_zone_with_year(spark):
    got = resolve_one(spark, "/l/auth.log", ["Dec 31 23:30:00 h p: a", "Jan  1 00:30:00 h p: b"], JAN_2024, "America/New_York")
    assert [r["ts_utc"] for r in got] == [stamp(2024, 1, 1, 4, 30), stamp(2024, 1, 1, 5, 30)]
    assert [r["year_inferred"] for r in got] == [2023, 2024]
    assert got[0]["timestamp_source"] == "log:inferred-tz" and got[0]["assumed_timezone"] == "America/New_York"
    assert got[0]["year_basis"] == resolve.SEED_MEMBER


def test_daylight_saving_edges_take_the_earlier_instant(spark):
    got = resolve_one(spark, "/l/auth.log", ["Mar 10 02:30:00 h p: gap", "Nov  3 01:30:00 h p: twice"], 1733011200, "America/New_York")
    assert [r["ts_utc"] for r in got] == [stamp(2024, 3, 10, 7, 30), stamp(2024, 11, 3, 5, 30)]


@pytest.mark.parametrize("scope, years", [("member", [2023, 2024, 2024, 2024]), ("set", [2022, 2023, 2023, 2024])])
@pytest.mark.parametrize("segment_rows", [1, 1000])
def test_years_per_member_or_over_the_rotated_set(spark, scope, years, segment_rows):
    files = {
        "/v/auth.log.2.gz": ["Aug  1 00:00:00 h p: a", "Feb  1 00:00:00 h p: b"],
        "/v/auth.log.1": ["Dec 30 00:00:00 h p: c"],
        "/v/auth.log": ["Jan  2 00:00:00 h p: d"],
    }
    found = member_rows(spark, list(files))
    stamps = spark.createDataFrame([(0, p, JAN_2024) for p in files], "volume_id long, path string, mtime long")
    members = resolve.seed_years(found, stamps).select(
        "evidence_source_id", "volume_id", "path", F.lit(0).cast("long").alias("volume_offset"), F.lit(1).cast("long").alias("file_id"),
        "seed_year", "seed_basis", "seed_unresolved", F.lit("UTC").alias("zone"), F.lit("etc-timezone").alias("tz_resolution"),
    )
    body = None
    for path, text_lines in files.items():
        part = lines(spark, path, text_lines)
        body = part if body is None else body.unionByName(part)
    out = resolve.resolve(parse.parse(body), members, segment_rows=segment_rows, scope=scope)
    assert [r.year_inferred for r in out.orderBy("message").collect()] == years


def test_unknown_zone_is_utc_with_a_warning(spark):
    got = resolve_one(spark, "/l/auth.log", ["Jan  1 00:30:00 h p: b"], JAN_2024, None)[0]
    assert got["ts_utc"] == stamp(2024, 1, 1, 0, 30) and got["timestamp_source"] == "log:assumed-utc"
    assert got["time_warning"].startswith("WARNING") and got["tz_resolution"] == "tz-undeterminable"


def test_line_without_time_falls_back_to_new_year_of_the_seed(spark):
    got = resolve_one(spark, "/l/syslog", ["no head"], 0, "America/New_York", newest=JAN_2024)[0]
    assert got["ts_utc"] == stamp(2024, 1, 1, 5, 0) and not got["is_undated"]
    assert got["resolved_basis"] == "file-mtime-fallback; no per-line timestamp"
    assert got["year_basis"] == resolve.SEED_NEWEST


def test_no_mtime_anywhere_goes_to_the_end(spark):
    got = resolve_one(spark, "/l/syslog", ["Jan  5 00:00:00 h p: x", "no head"], 0, None)
    assert all(r["is_undated"] and r["ts_utc"] == stamp(9999, 12, 31, 23, 59, 59) for r in got)
    assert got[0]["ts_resolved"] == "1970-01-05T00:00:00+00:00"
    assert got[0]["resolved_basis"] == resolve.YEAR_UNRESOLVED_BASIS and got[1]["resolved_basis"] == resolve.NO_TIME_BASIS


def test_epoch_bypasses_zone_and_year(spark):
    got = resolve_one(spark, "/home/a/.bash_history", ["#1736899200", "ls"], 0, "America/New_York")[0]
    assert got["ts_utc"] == stamp(2025, 1, 15, 0, 0) and got["timestamp_source"] == "log:embedded-epoch"
    assert got["assumed_timezone"] is None and got["year_inferred"] is None


def test_impossible_date_is_undated_and_consumes_no_other_row(spark):
    got = resolve_one(spark, "/l/syslog", ["Feb 30 10:00:00 h p: x", "Feb 28 10:00:00 h p: y"], JAN_2024, None)
    assert got[0]["is_undated"] and got[0]["resolved_basis"] == resolve.IMPOSSIBLE_DATE_BASIS
    assert got[1]["ts_utc"] == stamp(2024, 2, 28, 10, 0)


def test_offset_head(spark):
    body = ["<34>1 2026-05-31T12:00:00.500+02:00 h app - ID47 - m"]
    got = resolve_one(spark, "/l/syslog", body, JAN_2024, "America/New_York")[0]
    assert got["ts_utc"] == stamp(2026, 5, 31, 10, 0, 0, 500000) and got["timestamp_source"] == "log:rfc5424-offset"
    old = resolve_one(spark, "/l/syslog", body, JAN_2024, None, strict=True)[0]
    assert old["ts_utc"] == stamp(2024, 1, 1)


def test_events_keep_raw_and_sorted_attributes(spark):
    found = member_rows(spark, ["/l/auth.log"])
    members = found.select(
        "evidence_source_id", "volume_id", "path", F.lit(0).cast("long").alias("volume_offset"), F.lit(1).cast("long").alias("file_id"),
        F.lit(2024).alias("seed_year"), F.lit("b").alias("seed_basis"), F.lit(False).alias("seed_unresolved"),
        F.lit("UTC").alias("zone"), F.lit("etc-timezone").alias("tz_resolution"),
    )
    out = resolve.to_events(resolve.resolve(parse.parse(lines(spark, "/l/auth.log", ['Jan  5 00:00:00 h p: say "hi"'])), members)).first()
    assert out.event_type == "log" and out.meta_addr is None and out.file_id == 1
    assert out.attributes == (
        '{"assumed_timezone":"UTC","raw":"Jan  5 00:00:00 h p: say \\"hi\\"","rfc5424":false,'
        '"timestamp_source":"log:inferred-tz","tz_resolution":"etc-timezone","year_basis":"b","year_inferred":2024}'
    )


def test_host_zone_order(spark):
    rows = [
        (0, "/etc/localtime", "/usr/share/zoneinfo/Europe/Paris", None),
        (0, "/etc/timezone", None, "Asia/Tokyo\n"),
        (1, "/etc/localtime", "/usr/share/zoneinfo/No/Where", None),
        (1, "/etc/timezone", None, "\n Asia/Tokyo \nrest"),
        (2, "/etc/timezone", None, "nonsense"),
        (2, "/etc/passwd", None, "Asia/Tokyo"),
    ]
    df = spark.createDataFrame(rows, "volume_id long, path string, link_target string, text string")
    got = {r.volume_id: (r.zone, r.tz_resolution) for r in resolve.host_zones(df).collect()}
    assert got == {0: ("Europe/Paris", "etc-localtime"), 1: ("Asia/Tokyo", "etc-timezone"), 2: (None, "tz-undeterminable")}


def test_a_huge_index_is_a_range(spark):
    rows = member_rows(spark, ["/v/auth.log", "/v/auth.log.3", "/v/auth.log.3000000000"])
    got = discover.completeness(rows).first()
    assert got.missing_indices == [1, 2] and "[1, 2, 4-2999999999] absent" in got.note
    assert [tuple(g) for g in got.missing_ranges] == [(1, 2), (4, 2999999999)]


def test_zones_unknown_to_the_jvm_are_undeterminable(spark):
    rows = [(0, "/etc/timezone", None, "Factory"), (1, "/etc/timezone", None, "localtime"), (2, "/etc/timezone", None, "Asia/Tokyo")]
    got = {r.volume_id: r.zone for r in resolve.host_zones(spark.createDataFrame(rows, "volume_id long, path string, link_target string, text string")).collect()}
    assert got == {0: None, 1: None, 2: "Asia/Tokyo"}


def test_first_file_id_of_a_path(spark):
    rows = member_rows(spark, ["/v/auth.log", "/v/syslog"])
    files = spark.createDataFrame([(1, 9, "/v/auth.log"), (1, 4, "/v/auth.log")], "evidence_source_id long, file_id long, path string")
    got = {r.path: r.file_id for r in discover.with_file_id(rows, files).collect()}
    assert got == {"/v/auth.log": 4, "/v/syslog": None}


def test_members_are_inflated_and_decoded(spark):
    good = gzip.compress("Jan  1 00:00:00 h p: é\n\nx".encode())
    rows = [
        (0, "/v/auth.log.2.gz", True, bytearray(good)),
        (0, "/v/auth.log.3.gz", True, bytearray(good[:-9])),
        (0, "/v/auth.log.4.gz", True, bytearray(b"junk")),
        (0, "/v/auth.log", False, bytearray(b"a\r\nb\x0bc\xff\xe2\x80\xa8d\n")),
        (0, "/v/empty", False, bytearray(b"")),
    ]
    df = spark.createDataFrame(rows, "volume_id long, path string, is_gz boolean, content binary")
    got = {}
    for r in text.lines_of_members(df).orderBy("path", "line_ord").collect():
        got.setdefault(r.path, []).append(r.line)
    assert got == {
        "/v/auth.log.2.gz": ["Jan  1 00:00:00 h p: é", "", "x"],
        "/v/auth.log": ["a", "b", "c�", "d"],
    }


def test_inflating_has_no_limit_and_takes_padding(monkeypatch):
    monkeypatch.setattr(text, "INFLATE_STEP", 50)
    packed = gzip.compress(b"ab\ncd\n") + b"\0" * 700 + gzip.compress(b"e" * 5000 + b"\n\nx") + b"\0" * 9
    assert b"".join(text.inflated(packed)) == b"ab\ncd\n" + b"e" * 5000 + b"\n\nx"
    assert max(map(len, text.inflated(packed))) <= 50


def test_lines_of_pieces_are_those_of_the_whole(spark):
    rng = random.Random(5)
    marks = ["\n", "\r\n", "\r", "\x0b", "\u2028", "é", "a", "bc", "東", "x" * 40, "\n\n"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.choice([0, 1, 5, 60, 400]))) for _ in range(40)] + ["\n", "a\n", "\r\n" * 9, "z" * 500, ""]
    data = [t.encode() for t in texts] + [b"\xff\xe2\x80\n\xa8 \xc3" * 30]
    members = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "id long, content binary")
    whole = members.withColumn("t", text.decoded(F.col("content")))
    want = [(r.id, r.line) for r in text.lines_of(whole.select("id", "t"), F.col("t")).orderBy("id", "line_ord").collect()]
    for size, segment in ((1, 3), (2, 5), (7, 4096), (64, 2), (1 << 20, 4096)):
        lines = text.lines_of_pieces(text.cut_pieces(members, ["id"], size), ["id"], segment)
        assert [(r.id, r.line) for r in lines.orderBy("id", "line_ord", "line_sub").collect()] == want, size
    paths = members.selectExpr("0L as volume_id", "string(id) as path", "false as is_gz", "content")
    got = text.lines_of_members(paths, piece_bytes=11).orderBy(F.col("path").cast("int"), "line_ord", "line_sub").collect()
    assert [(int(r.path), r.line) for r in got] == want


@pytest.mark.parametrize("data", [b"", b"junk", gzip.compress(b"abc" * 99)[:-9], gzip.compress(b"abc") + b"junk", b"\0" * 20])
def test_damage_is_told(data):
    assert text.damage(data)


def test_large_member_in_pieces_and_damage_rows(spark, monkeypatch):
    body = "".join(f"line {i}\r\n" for i in range(300_000))
    good = gzip.compress(body.encode())
    rows = [(0, "/v/a.gz", True, bytearray(good)), (0, "/v/b.gz", True, bytearray(good[:-30])), (0, "/v/c", False, bytearray(b"x"))]
    df = spark.createDataFrame(rows, "volume_id long, path string, is_gz boolean, content binary")
    assert [(r.path, bool(r.reason)) for r in text.damaged_members(df).collect()] == [("/v/b.gz", True)]
    got = text.lines_of_members(df.where("path = '/v/a.gz'")).orderBy("line_ord", "line_sub").collect()
    assert [r.line for r in got] == body.split("\r\n")[:-1] and got[-1].line_ord > 1 << 32


def test_lines_of_a_split_file_stay_in_order(spark, tmp_path):
    body = [f"line {i} " + "x" * (i % 50) for i in range(20000)]
    body[500] = "left\x0bright"
    (tmp_path / "auth.log").write_text("\n".join(body) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = text.read_log_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 5
        rows = [r.line for r in got.orderBy("line_ord", "line_sub").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == body[:500] + ["left", "right"] + body[501:]
