"""The stages of a small case end to end, sources, sinks and repeatability."""

import datetime
import gzip
import hashlib
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from caseframe import schemas
from caseframe.operators import ordered, quality, report
from caseframe.plans import analyze
from caseframe.sources import evidence, text
from caseframe.sources.tables import CaseTables, write_recovered

AUTH = b"Dec 31 23:30:00 h sshd[1]: Failed password for root from 10.0.0.9\nJan  1 00:10:00 h sudo: amy : COMMAND=/bin/id\n"
OLD = gzip.compress(b"Dec 20 10:00:00 h sshd[1]: Accepted password for amy from 10.0.0.9\n")
HIST = b"ls\n#1704067200\ncurl evil-c2.example.invalid\n"
NOTE = b"." * 64 + b"SECRET-NEEDLE" + b"." * 9
BAD = b"malware body"
NY = "America/New_York"
MTIME = 1704171600


def inventory_entries(spark):
    def row(i, path, content, **kw):
        base = {f.name: None for f in schemas.ENTRIES.fields}
        base.update(
            evidence_source_id=1, file_id=i, volume_id=0, volume_offset=0, name=path.rsplit("/", 1)[-1], path=path, parent_addr=2,
            meta_addr=100 + i, name_alloc=True, meta_alloc=True, meta_type_code=1, fs_type_code=8192, size=len(content),
            uid=1000, gid=1000, mode=0o644, mtime=MTIME, atime=0, ctime=MTIME, crtime=0, content=bytearray(content),
        )
        base.update(kw)
        return tuple(base[f.name] for f in schemas.ENTRIES.fields)

    return spark.createDataFrame(
        [
            row(1, "/var/log/auth.log", AUTH),
            row(2, "/var/log/auth.log.2.gz", OLD),
            row(3, "/home/amy/.bash_history", HIST),
            row(4, "/evidence_note.txt", NOTE),
            row(5, "/malware_sample.bin", BAD),
            row(6, "/gone.txt", b"gone", name_alloc=False, meta_alloc=False),
        ],
        schemas.ENTRIES,
    )


def run_case(spark, root):
    tables = CaseTables(spark, root)
    case = spark.createDataFrame([(1, "c", "e", None, "{}")], schemas.CASES)
    source = spark.createDataFrame([(1, 1, "ev", "/img.dd", "raw", None, None, 1 << 22, "{}")], schemas.EVIDENCE_SOURCES)
    analyze.open_case(tables, case, source)
    entries = inventory_entries(spark)
    volumes = spark.createDataFrame(
        [(1, 0, 0, "Linux", None, None), (1, 1, 4096, "crypt", "cannot open", bytearray(b"LUKS\xba\xbe"))],
        "evidence_source_id long, volume_id long, volume_offset long, description string, error string, head binary",
    )
    analyze.run_walk(tables, entries, volumes)
    nodes = spark.createDataFrame(
        [(0, 0, 2, 0, "dir", True, False, False, False, []), (0, 0, 104, 86, "reg", True, False, False, False, [(3, 1)]), (0, 0, 106, 4, "reg", False, False, False, False, [(7, 1)]), (0, 0, 200, 9, "reg", False, False, False, False, [(3, 1)])],
        schemas.INODES,
    )
    links = entries.select(
        "volume_id", "volume_offset", "meta_addr", "name", "path", "parent_addr", (F.col("name_alloc") & F.col("meta_alloc")).alias("allocated"),
        F.lit("reg").alias("meta_type"), F.col("file_id").alias("entry_ordinal"),
    )
    contents = spark.createDataFrame([(0, 106, bytearray(b"gone"))], "volume_id long, meta_addr long, content binary")
    analyze.run_recover(tables, links, nodes, contents)
    listed = spark.createDataFrame([(hashlib.sha1(BAD).hexdigest(),)], "value string")
    reference = spark.createDataFrame([(hashlib.md5(NOTE).hexdigest().upper(),)], "md5 string")
    analyze.run_filter(tables, [analyze.HashList(listed, "mine", "block")], reference)
    analyze.run_timeline(tables)
    config = spark.createDataFrame([(0, "/etc/localtime", f"/usr/share/zoneinfo/{NY}", None)], "volume_id long, path string, link_target string, text string")
    analyze.run_logs(tables, entries.select("volume_id", "volume_offset", "path", "content"), config, entries.select("volume_id", "path", "mtime"))
    blocks = spark.createDataFrame(
        [(0, 0, i, bytearray(d)) for i, d in enumerate([b"." * 16, b"...UNALLOC-NEEDL", b"E" + b"." * 15, b"UNALLOC-NEEDLE.."])],
        "volume_id long, volume_offset long, block_index long, data binary",
    )
    objects = tables.read("files", 1).where("recovered is null").join(entries.select("file_id", "content"), "file_id")
    analyze.run_search(
        tables, objects, [b"SECRET-NEEDLE", b"UNALLOC-NEEDLE"], [r"evil-[a-z0-9]+"], [b"evil-c2.example.invalid"],
        spark.createDataFrame([(hashlib.md5(BAD).hexdigest(),)], "value string"), blocks, nodes, 16,
    )
    return tables


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    return run_case(spark, str(tmp_path_factory.mktemp("case")))


def test_every_table_has_its_schema_and_vocabulary(case):
    for name, schema in schemas.TABLES.items():
        df = case.read(name)
        assert quality.schema_drift(df, schema) == [] and (df.count() > 0 or name == "integrity_checks"), name
        assert quality.outside_domain(df, name).count() == 0
        if "attributes" in schema.fieldNames():
            assert quality.invalid_attributes(df).count() == 0
    for child in ("timeline_events", "search_hits", "known_file_matches"):
        assert quality.orphan_references(case.read(child), case.read("files"), ["file_id"]).count() == 0


def test_super_timeline(case):
    events = case.read("timeline_events", 1)
    logs = {(r.path, r.ts_utc): r for r in events.where("source not like 'filesystem%'").collect()}
    stamps = sorted((t, p) for p, t in logs)
    assert [s[0] for s in stamps] == [
        datetime.datetime(2024, 1, 1, 0, 0),
        datetime.datetime(2024, 1, 1, 4, 30),
        datetime.datetime(2024, 1, 1, 5, 0),
        datetime.datetime(2024, 1, 1, 5, 10),
        datetime.datetime(2024, 12, 20, 15, 0),
    ]
    assert events.where("source like 'filesystem%'").count() == 12
    assert {r.file_id for r in logs.values()} == {1, 2, 3}


def test_recovered_rows_and_tiers(case):
    got = {r.meta_addr: r for r in case.read("files", 1).where("recovered").collect()}
    assert (got[106].confidence_tier, got[106].is_orphan, got[106].md5) == ("intact", False, hashlib.md5(b"gone").hexdigest())
    assert (got[200].confidence_tier, got[200].is_orphan) == ("partial/overwritten", True)
    assert '"overlapping_blocks":[3]' in got[200].attributes


def test_hits(case):
    got = sorted((r.term, r.term_kind, r.region, r.byte_offset, r.block_index, r.path) for r in case.read("search_hits").collect())
    at = HIST.find(b"evil")
    assert got == sorted([
        ("SECRET-NEEDLE", "literal", "allocated", 64, None, "/evidence_note.txt"),
        ("UNALLOC-NEEDLE", "literal", "unallocated", 19, 1, None),
        (hashlib.md5(BAD).hexdigest(), "hash", "metadata", None, None, "/malware_sample.bin"),
        ("evil-c2", "regex", "allocated", at, None, "/home/amy/.bash_history"),
        ("evil-c2.example.invalid", "ioc", "allocated", at, None, "/home/amy/.bash_history"),
    ])


def test_recovered_contents_come_from_blocks(spark, tmp_path):
    """The deleted inode's bytes and digests, read from the blocks of the image; what cannot be read ends a file."""
    tables = CaseTables(spark, str(tmp_path / "case"))
    analyze.open_case(
        tables, spark.createDataFrame([(1, "c", "e", None, "{}")], schemas.CASES),
        spark.createDataFrame([(1, 1, "ev", "/img.dd", "raw", None, None, 1 << 22, "{}")], schemas.EVIDENCE_SOURCES),
    )
    image = b"".join(bytes([97 + i]) * 8 for i in range(20)) + b"tail"
    (tmp_path / "img.dd").write_bytes(image)
    blocks = evidence.read_blocks(spark, str(tmp_path / "img.dd"), 8).where("block_index <> 6")
    nodes = spark.createDataFrame(
        [(0, 0, 13, 30, "reg", False, False, False, False, [(9, 2), (2, 2)]), (0, 0, 14, 30, "reg", False, False, False, False, [(4, 4)]), (0, 0, 15, 4, "reg", False, False, False, False, [(20, 1)])],
        schemas.INODES,
    )
    links = spark.createDataFrame([(0, 0, 13, "a.txt", "/a.txt", 2, False, "reg", 1)], "volume_id long, volume_offset long, meta_addr long, name string, path string, parent_addr long, allocated boolean, meta_type string, entry_ordinal long")
    analyze.run_recover(tables, links, nodes, recovered_folder=str(tmp_path / "out"), blocks=blocks, block_size=8)
    rows = {r.meta_addr: r for r in tables.read("files", 1).collect()}
    body = (b"j" * 8 + b"k" * 8 + b"c" * 8 + b"d" * 8)[:30]
    assert rows[13].sha256 == hashlib.sha256(body).hexdigest() and rows[13].file_type == "text/plain"
    assert rows[14].md5 is None and '"hash_skipped":"short_read"' in rows[14].attributes
    assert rows[15].md5 == hashlib.md5(b"tail").hexdigest()
    kept = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r.recovered_path, r.base)):
        kept[r.recovered_path] = kept.get(r.recovered_path, b"") + bytes(r.data)
    assert kept == {"recovered/vol0-off0/13-a.txt": body, "recovered/vol0-off0/14-inode-14": b"e" * 8 + b"f" * 8, "recovered/vol0-off0/15-inode-15": b"tail"}


def test_log_counts_read_no_filesystem_events(case, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    log_rows = case.read("timeline_events", 1, "log")
    text = report.log_by_source(log_rows)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = re.search(r"PartitionFilters: (\[[^\n]*?\]), PushedFilters", text).group(1)
    assert "evidence_source_id" in filters and "family" in filters and "source" not in filters.replace("evidence_source_id", "")
    files = {f for f in log_rows.inputFiles()}
    assert log_rows.where("source like 'filesystem%'").count() == 0 and files
    assert case.has_family("timeline_events", 1, "filesystem") and not case.has_family("timeline_events", 2, "filesystem")
    assert case.read("timeline_events", 1).count() == log_rows.count() + case.read("timeline_events", 1, "filesystem").count()
    with pytest.raises(ValueError):
        case.read("files", 1, "log")


def test_listings_have_positions_in_order(case, spark, tmp_path):
    analyze.write_sections(case, str(tmp_path / "report"), 1)
    for name, (rows, order) in analyze.report_listings(case, 1).items():
        listed = spark.read.parquet(str(tmp_path / "report" / f"listing_{name}")).orderBy("position").collect()
        assert [r.position for r in listed] == list(range(1, rows.count() + 1))
        assert [tuple(r[c] for c in order) for r in listed] == [tuple(r) for r in rows.orderBy(*order).select(order).collect()]


def test_positions_over_many_partitions(spark):
    rows = spark.range(5000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("a"), F.col("id").alias("b"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.numbered(rows, ["a", "b"], partitions=9).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted((r.a, r.b) for r in rows.collect())
    assert {r.position: (r.a, r.b) for r in got} == dict(enumerate(want, 1)) and len(got) == 5000
    assert ordered.numbered(rows.limit(0), ["a"]).count() == 0


def test_acquisition_and_reverification(spark, case):
    digests = {r.path: r for r in case.read("files", 1).where("recovered is null and md5 is not null").collect()}
    note, bad = "/evidence_note.txt", "/malware_sample.bin"
    rows = [(note, digests[note].sha256.upper()), (bad, "0" * 32), ("/home/amy/.bash_history", "zz")]
    baseline = [(note, digests[note].md5, digests[note].sha256), (bad, "1" * 32, "2" * 64), ("/was", "3" * 32, "4" * 64)]
    analyze.run_verify(case, spark.createDataFrame(rows, "path string, supplied string"), spark.createDataFrame(baseline, "path string, md5 string, sha256 string"))
    got = {(r.check, r.path): r.outcome for r in case.read("integrity_checks", 1).collect()}
    assert got[("acquisition", note)] == "PASS" and got[("acquisition", bad)] == "FAIL"
    assert got[("acquisition", "/home/amy/.bash_history")] == "MALFORMED" and got[("acquisition", "/var/log/auth.log")] == "NOT_COMPARED"
    assert got[("reverify", bad)] == "changed" and got[("reverify", "/was")] == "vanished" and ("reverify", note) not in got
    one = analyze.report_sections(case, 1)["integrity"].first()
    assert one.acquisition_supplied and not one.acquisition_compare_pass and not one.reverify_pass and not one.passed
    head = analyze.report_sections(case, 1)["header"].first()
    assert (head.case_name, head.evidence_id, head.acquisition_source) == ("c", "ev", "/img.dd")
    nothing = report.integrity(case.read("integrity_checks", 99)).first()
    assert nothing.passed and not nothing.acquisition_compare_pass and not nothing.acquisition_supplied


def test_what_a_parser_adds_is_in_the_attributes(spark, tmp_path):
    from caseframe.operators.logs import parse

    def records(lines):
        n = F.length("line")
        extra = F.to_json(F.struct(n.alias("size"), (n > 3).alias("long"), F.array(n, n).alias("twice"), F.lit("mine").alias("kind"), F.lit("x").alias("ts_basis")))
        return lines.select("volume_id", "path", "line_ord", "line_sub", "line", F.lit(1704067200).cast("long").alias("epoch"), F.lit("k").alias("kind"), extra.alias("extra"))

    tables = CaseTables(spark, str(tmp_path / "case"))
    case = spark.createDataFrame([(1, "c", "e", None, "{}")], schemas.CASES)
    analyze.open_case(tables, case, spark.createDataFrame([(1, 1, "ev", "/img.dd", "raw", None, None, 1, "{}")], schemas.EVIDENCE_SOURCES))
    entries = inventory_entries(spark)
    analyze.run_walk(tables, entries)
    config = spark.createDataFrame([], "volume_id long, path string, link_target string, text string")
    mine = parse.Parser("mine", lambda path: path.endswith("auth.log"), records=records)
    found = entries.select("volume_id", "volume_offset", "path", "content")
    analyze.run_logs(tables, found, config, entries.select("volume_id", "path", "mtime"), parsers=(mine, *parse.PARSERS))
    got = [json.loads(r.attributes) for r in tables.read("timeline_events", 1, "log").where("source = 'mine'").orderBy("line_ord").collect()]
    sizes = [len(x) for x in AUTH.decode().splitlines()]
    assert [(a["size"], a["long"], a["twice"], a["kind"]) for a in got] == [(n, True, [n, n], "k") for n in sizes]
    assert all(list(a) == sorted(a) and a["timestamp_source"] == "log:embedded-epoch" for a in got)


def test_sections(case, tmp_path):
    sections = analyze.report_sections(case, 1)
    got = {n: [r.asDict() for r in df.collect()] for n, df in sections.items() if n != "timeline_head"}
    assert got["inventory"] == [{"file_count": 6, "directory_count": 0, "deleted_count": 1}]
    assert got["recovery"] == [{"files_recovered": 2, "intact_count": 1, "overwritten_count": 1, "orphan_count": 1}]
    assert got["known_nsrl"] == [{"hash": "md5", "count": 1}]
    assert [(r["list_name"], r["count"]) for r in got["known_custom"]] == [("known-bad", 1), ("mine", 1)]
    assert got["known_files"] == [{"files_matched": 2}]
    assert [(r["source"], r["count"]) for r in got["log_sources"]] == [("auth", 3), ("shell-history", 2)]
    assert got["log_run"] == [{"events_parsed": 5, "auth_events": 3, "log_sets": 2, "findings_count": 3}]
    assert got["coverage"][0]["excluded"] == [] and len(got["coverage"][0]["covered"]) == 7
    assert got["limitations"][0]["attributes"] == '{"encryption_hint":"likely LUKS"}'
    analyze.write_sections(case, str(tmp_path / "report"), 1)
    parts = [f for f in os.listdir(tmp_path / "report" / "inventory") if f.endswith(".json")]
    assert len(parts) == 1
    assert json.loads((tmp_path / "report" / "inventory" / parts[0]).read_text()) == got["inventory"][0]


def test_a_second_run_has_the_same_digests(spark, case, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        other = run_case(spark, str(tmp_path / "again"))
        for name in ("files", "timeline_events", "search_hits", "known_file_matches", "log_findings"):
            assert quality.result_digest(case.read(name)).first() == quality.result_digest(other.read(name)).first(), name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_source_is_registered_once_and_stages_once(spark, case):
    with pytest.raises(analyze.StageError):
        analyze.open_case(case, case.read("cases"), case.read("evidence_sources"))
    case.record_stage(1, "logs")
    assert case.read("run_log").where("stage = 'logs'").count() == 1
    with pytest.raises(ValueError):
        case.record_stage(1, "guess")
    assert case.latest_source() == 1


def test_ordered_write_is_sorted_across_files(spark, tmp_path):
    tables = CaseTables(spark, str(tmp_path))
    rows = spark.range(2000).select(
        F.lit(1).cast("long").alias("evidence_source_id"), F.lit(None).cast("long").alias("file_id"), F.lit("allocated").alias("region"), F.lit("t").alias("term"),
        F.lit("ioc").alias("term_kind"), F.lit(0).cast("long").alias("volume_id"), F.lit(0).cast("long").alias("volume_offset"),
        (F.pmod(F.col("id") * 7919, F.lit(2000))).alias("byte_offset"), F.lit(None).cast("long").alias("block_index"), F.lit("/p").alias("path"), F.lit(None).cast("string").alias("context"), F.lit("{}").alias("attributes"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tables.append_in_order("search_hits", rows.repartition(3), schemas.ORDER_HITS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    with_file = tables.spark.read.parquet(tables.path("search_hits")).select("byte_offset", F.input_file_name().alias("f"))
    spans = with_file.groupBy("f").agg(F.min("byte_offset").alias("lo"), F.max("byte_offset").alias("hi")).orderBy("lo").collect()
    assert len(spans) > 1 and all(a.hi < b.lo for a, b in zip(spans, spans[1:]))
    for f in [r.f for r in with_file.select("f").distinct().collect()]:
        values = [r.byte_offset for r in spark.read.parquet(f).coalesce(1).collect()]
        assert values == sorted(values)


def test_tree_blocks_lists_and_reference_sources(spark, tmp_path):
    (tmp_path / "tree" / "sub").mkdir(parents=True)
    (tmp_path / "tree" / "a.bin").write_bytes(b"12345")
    (tmp_path / "tree" / "sub" / "b.bin").write_bytes(b"x" * 100)
    got = {os.path.basename(r.path): (r.size, r.content and bytes(r.content)) for r in evidence.read_tree(spark, str(tmp_path / "tree"), max_bytes=50).collect()}
    assert got == {"a.bin": (5, b"12345"), "b.bin": (100, None)}
    (tmp_path / "img.dd").write_bytes(b"".join(bytes([65 + i]) * 8 for i in range(6)))
    blocks = evidence.read_blocks(spark, str(tmp_path / "img.dd"), 8, 3, 16).orderBy("block_index").collect()
    assert [(r.block_index, bytes(r.data)[:1]) for r in blocks] == [(0, b"C"), (1, b"D"), (2, b"E"), (3, b"F")]
    (tmp_path / "short.dd").write_bytes(bytes(range(45)))
    odd = evidence.read_blocks(spark, str(tmp_path / "short.dd"), 8, 0, 5).orderBy("block_index").collect()
    assert [bytes(r.data) for r in odd] == [bytes(range(k, min(k + 8, 45))) for k in range(5, 45, 8)]
    for size, block, offset in ((512 * 40, 512, 0), (512 * 41, 1024, 0), (512 * 37, 700, 33), (512 * 6, 4096, 0), (512 * 2100, 512, 512), (0, 8, 0)):
        (tmp_path / "sectors.dd").write_bytes(image := random.Random(size).randbytes(size))
        got = evidence.read_blocks(spark, f"file:{tmp_path}/sectors.dd", block, 3, offset).orderBy("block_index").collect()
        assert [r.block_index for r in got] == list(range(-(-max(size - offset, 0) // block)))
        assert b"".join(bytes(r.data) for r in got) == image[offset:] and all(len(r.data) == block for r in got[:-1])
        ranges = evidence.read_images(spark, [evidence.Image(str(tmp_path / "sectors.dd"), 3, offset)], block).orderBy("block_index").collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in ranges]
    (tmp_path / "bad.txt").write_bytes(b"ok\n\xff\xfe\n")
    with pytest.raises(Exception, match="(?i)utf"):
        text.read_list(spark, str(tmp_path / "bad.txt")).collect()
    terms = spark.createDataFrame([(3, "b"), (1, " b "), (2, "# c"), (4, ""), (5, "a")], "line_no long, value string")
    assert sorted((r.term, r.first_line) for r in text.ioc_terms(terms).collect()) == [("a", 5), ("b", 1)]
    ref = str(tmp_path / "ref")
    spark.createDataFrame([("AA",)], "md5 string").write.parquet(f"{ref}/METADATA")
    assert evidence.read_reference(spark, ref).first().md5 == "AA"
    with pytest.raises(ValueError):
        evidence.pick_variant(["OTHER"])
    assert evidence.pick_variant(["METADATA", "FILE"]) == "FILE"


def test_recovered_contents_sink(spark, tmp_path):
    rows = [("recovered/vol0-off0/1-a", 3, bytearray(b"abc")), ("recovered/vol0-off0/2-b", 99, bytearray(b"x" * 99)), ("recovered/vol0-off0/3-c", 0, None)]
    df = spark.createDataFrame(rows, "recovered_path string, size long, content binary")
    write_recovered(df, str(tmp_path / "out"), max_bytes=50)
    got = {r.recovered_path[-1]: bytes(r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": b"abc", "b": b"", "c": b""}


def test_entries_read_with_a_fixed_schema(spark, tmp_path):
    inventory_entries(spark).write.parquet(str(tmp_path / "e"))
    assert evidence.read_entries(spark, str(tmp_path / "e")).schema.fieldNames() == schemas.ENTRIES.fieldNames()
