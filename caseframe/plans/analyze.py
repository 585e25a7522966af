"""The analysis stages over case tables.

Each stage reads tables, runs one set of operators, appends its result and
notes that it ran, whether or not it found anything. Results are written before
they are read by the next stage, so no stage recomputes another.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe import schemas
from caseframe.functions import names, signatures
from caseframe.operators import contents as pieced
from caseframe.operators import inventory, known, quality, recovery, report, search, timeline
from caseframe.operators.logs import discover, parse, resolve
from caseframe.operators.ordered import settled, top_n
from caseframe.session import pin
from caseframe.sources import text
from caseframe.sources.tables import FILESYSTEM, LOG, CaseTables, write_listing, write_pieces, write_recovered, write_report

BAD_LIST = "known-bad"


class StageError(ValueError):
    """A stage cannot run on this case."""


@dataclass(frozen=True)
class HashList:
    """A custom list: its lines (column ``value``), display name and sense."""

    lines: DataFrame
    name: str
    sense: str


def open_case(tables: CaseTables, case: DataFrame, source: DataFrame) -> None:
    """Register a case and an evidence source; a known source id is refused."""
    pin(tables.spark)
    keys = ["evidence_source_id"]
    clash = source.join(tables.read("evidence_sources").select(*keys), keys, "left_semi")
    if not clash.isEmpty():
        raise StageError("evidence source already registered")
    existing = tables.read("cases").select("case_id")
    tables.append("cases", case.join(existing, ["case_id"], "left_anti"))
    tables.append("evidence_sources", source)


def _source(tables: CaseTables, evidence_source_id: int | None) -> int:
    found = evidence_source_id if evidence_source_id is not None else tables.latest_source()
    if found is None:
        raise StageError("no evidence source in the case")
    return found


def _case_of(tables: CaseTables, source: int) -> int:
    row = tables.read("evidence_sources", source).select("case_id").first()
    if row is None:
        raise StageError(f"unknown evidence source {source}")
    return row[0]


def run_walk(
    tables: CaseTables,
    entries: DataFrame,
    volumes: DataFrame | None = None,
    zone: str = "UTC",
    max_hash_size: int | None = None,
    typer: Callable[[Column], Column] = signatures.file_type,
) -> None:
    """Inventory and, for volumes that could not be opened, limitation rows."""
    tables.append("files", inventory.normalize(entries, zone, max_hash_size, typer))
    if volumes is not None:
        _, limits = inventory.split_volumes(volumes)
        tables.append("volume_limitations", limits)


def run_recover(
    tables: CaseTables,
    entries: DataFrame,
    inodes: DataFrame,
    contents: DataFrame | None = None,
    max_hash_size: int | None = None,
    evidence_source_id: int | None = None,
    recovered_folder: str | None = None,
    blocks: DataFrame | None = None,
    block_size: int = 4096,
) -> None:
    """Deleted inodes with tiers as additional file rows.

    ``entries`` are directory entries with ``allocated``, ``meta_type`` and
    ``entry_ordinal``. Contents are given (``contents``), or put together from
    the image's ``blocks`` (volume_id, block_index, data). With
    ``recovered_folder`` they are written there under their confined names, from
    blocks as pieces in order, up to the first block that cannot be read.
    """
    source = _source(tables, evidence_source_id)
    found = recovery.deleted_inodes(entries, inodes)
    inode, pieces, told = ["volume_id", "meta_addr"], None, None
    if contents is None and blocks is not None:
        wanted = inodes.join(found.select(*inode), inode, "left_semi")
        pieces = tables.staged("recovered_pieces", pieced.recovered_chunks(wanted, blocks, block_size), source)
        read = pieced.chunk_digests(pieces, wanted, inode, max_hash_size)
        heads = pieces.where("base = 0").select(*inode, F.col("data").alias("head"))
        told = tables.staged("recovered_digests", read.join(heads, inode, "left"), source)
    rows = recovery.recovered_rows(found, recovery.with_tier(inodes, live=True), source, contents, max_hash_size, told)
    tables.append("files", rows)
    kept = tables.read("files", source).where("recovered").select(*inode, "size", "recovered_path")
    if contents is not None and recovered_folder is not None:
        write_recovered(kept.join(contents.select(*inode, "content"), inode), recovered_folder)
    if pieces is not None and recovered_folder is not None:
        whole = pieced.readable(pieces, told.where(~F.col("hash_skipped").eqNullSafe(recovery.TOO_BIG)), inode)
        write_pieces(kept.join(whole, inode), recovered_folder)
    tables.record_stage(_case_of(tables, source), "recover")


def run_verify(
    tables: CaseTables,
    manifest: DataFrame,
    baseline: DataFrame | None = None,
    evidence_source_id: int | None = None,
) -> None:
    """Acquisition compare and re-verification of the files of a source.

    ``manifest``: path, supplied (a digest, or NULL). ``baseline``: path, md5,
    sha256 of an earlier run; what changed, appeared or vanished since is noted.
    """
    source = _source(tables, evidence_source_id)
    files = report.inventory_rows(tables.read("files", source)).where("md5 is not null or sha256 is not null")
    digests = files.groupBy("path").agg(F.min("md5").alias("md5"), F.min("sha256").alias("sha256"))
    tables.append("integrity_checks", quality.acquisition_rows(quality.verify_manifest(digests, manifest), source))
    if baseline is not None:
        tables.append("integrity_checks", quality.drift_rows(quality.manifest_drift(baseline, digests), source))


def run_filter(
    tables: CaseTables,
    lists: Sequence[HashList] = (),
    reference: DataFrame | None = None,
    evidence_source_id: int | None = None,
) -> None:
    """Known-hash annotations from custom lists and a reference table."""
    source = _source(tables, evidence_source_id)
    files = tables.read("files", source)
    parts = []
    if lists:
        joined = None
        for item in lists:
            one = known.hash_list(item.lines, item.name, item.sense)
            joined = one if joined is None else joined.unionByName(one)
        parts.append(known.match_lists(files, joined))
    if reference is not None:
        parts.append(known.match_reference(files, known.reference_hashes(reference)))
    for part in parts:
        tables.append("known_file_matches", part)
    tables.record_stage(_case_of(tables, source), "filter")


def run_timeline(tables: CaseTables, evidence_source_id: int | None = None) -> None:
    """Filesystem events, written range-partitioned by the total order."""
    source = _source(tables, evidence_source_id)
    events = timeline.macb_events(tables.read("files", source))
    tables.append_in_order("timeline_events", events, schemas.ORDER_TIMELINE)


def run_logs(
    tables: CaseTables,
    contents: DataFrame,
    config_files: DataFrame,
    file_times: DataFrame,
    extra_lines: DataFrame | None = None,
    evidence_source_id: int | None = None,
    parsers: tuple[parse.Parser, ...] = parse.PARSERS,
    strict_rfc5424: bool = False,
    year_scope: str = "member",
) -> None:
    """Log events and disclosures.

    ``contents``: volume_id, volume_offset, path, content of the inventory.
    ``extra_lines`` are lines of large plain files read in splits; their paths
    must be in ``contents`` (content may be NULL there). ``config_files`` as in
    ``resolve.host_zones``, ``file_times`` as in ``resolve.seed_years``.
    """
    source = _source(tables, evidence_source_id)
    files = tables.read("files", source)
    found = discover.members(contents.withColumn("evidence_source_id", F.lit(source).cast("long")))
    # Members are inflated once; lines are read for the records and for what was read.
    lines = tables.staged("log_lines", text.lines_of_members(found), source)
    if extra_lines is not None:
        lines = lines.unionByName(extra_lines)
    zones = resolve.host_zones(config_files)
    seeded = resolve.seed_years(
        discover.with_file_id(found.drop("content"), files), file_times
    ).join(zones, ["volume_id"], "left")
    members = seeded.select(
        "evidence_source_id",
        "volume_id",
        "path",
        "volume_offset",
        "file_id",
        "seed_year",
        "seed_basis",
        "seed_unresolved",
        "zone",
        F.coalesce("tz_resolution", F.lit("tz-undeterminable")).alias("tz_resolution"),
    )
    # Year inference reads the records twice; parsing runs once.
    records = tables.staged("log_records", parse.parse(lines, parsers), source)
    resolved = resolve.resolve(records, members, strict_rfc5424, scope=year_scope)
    if not tables.has_family("timeline_events", source, FILESYSTEM):
        run_timeline(tables, source)
    events = settled(resolve.to_events(resolved))
    tables.append_in_order("timeline_events", events, schemas.ORDER_TIMELINE)
    histories = names.leaf(F.col("path")).isin(*discover.HISTORY_LEAVES)
    read = lines.where(histories).select("volume_id", "path").distinct()
    findings = discover.disclosures(found.drop("content"), read)
    findings = findings.unionByName(discover.damage_findings(text.damaged_members(found)))
    for parser in parsers:
        if parser.findings is not None:
            findings = findings.unionByName(parser.findings(found.drop("content")))
    tables.append("log_findings", findings)
    tables.record_stage(_case_of(tables, source), "logs")


def run_search(
    tables: CaseTables,
    objects: DataFrame,
    literals: Sequence[bytes] = (),
    regexes: Sequence[str] = (),
    iocs: Sequence[bytes] | DataFrame = (),
    bad_hashes: DataFrame | None = None,
    blocks: DataFrame | None = None,
    inodes: DataFrame | None = None,
    block_size: int = 4096,
    chunks: DataFrame | None = None,
    evidence_source_id: int | None = None,
) -> None:
    """Content hits, hits in unallocated blocks, and known-bad hashes as hits.

    ``objects``: the inventory with content. ``chunks`` hold the content of
    files too large for one row (file columns, base, data). ``blocks`` and
    ``inodes`` add the unallocated region. ``iocs`` are terms, or a table with
    a column ``term`` (text or binary) as ``text.ioc_terms`` gives it.
    ``bad_hashes`` are list lines (column ``value``).
    """
    source = _source(tables, evidence_source_id)
    terms, table = [(t, "literal") for t in literals], None
    if isinstance(iocs, DataFrame):
        table = iocs.select(F.col("term").cast("binary").alias("term"), F.lit("ioc").alias("kind"))
    else:
        terms += [(t, "ioc") for t in iocs]
    if terms or regexes or table is not None:
        if terms or regexes:
            tables.append("search_hits", search.search_objects(search.searchable(objects), terms, regexes))
        if table is not None:
            tables.append("search_hits", search.search_term_table(search.searchable(objects), table))
        if chunks is not None:
            tables.append("search_hits", search.search_file_chunks(chunks, terms, regexes, terms=table))
        if blocks is not None and inodes is not None:
            free = recovery.unallocated(blocks, inodes).withColumn(
                "evidence_source_id", F.lit(source).cast("long")
            )
            tables.append("search_hits", search.search_blocks(free, block_size, terms, regexes, terms=table))
    if bad_hashes is not None:
        files = tables.read("files", source)
        matches = known.match_lists(files, known.hash_list(bad_hashes, BAD_LIST, "block"))
        tables.append("known_file_matches", matches)
        tables.append("search_hits", known.hash_hits(matches, files))
    tables.record_stage(_case_of(tables, source), "search")


def report_sections(tables: CaseTables, evidence_source_id: int | None = None) -> dict[str, DataFrame]:
    """The small breakdowns of a report; the large tables are read in order instead."""
    source = _source(tables, evidence_source_id)
    files = tables.read("files", source)
    events = tables.read("timeline_events", source)
    log_rows = tables.read("timeline_events", source, LOG)
    findings = tables.read("log_findings", source)
    checks = tables.read("integrity_checks", source)
    matches = tables.read("known_file_matches", source)
    hits = tables.read("search_hits", source)
    run_log = tables.read("run_log").where(F.col("case_id") == _case_of(tables, source))
    evidenced = {
        "recover": files.where("recovered"),
        "filter": matches,
        "logs": findings,
        "search": hits,
    }
    evidence = tables.read("evidence_sources", source)
    return {
        "header": report.header(tables.read("cases"), evidence),
        "evidence_hashes": evidence.select("evidence_source_id", "path", "byte_size", "md5", "sha256"),
        "integrity": report.integrity(checks),
        "integrity_failures": checks.where("outcome not in ('PASS', 'NOT_COMPARED')").orderBy("check", "path", "outcome"),
        "inventory": report.inventory_counts(files),
        "walk": report.walk_counts(files, tables.read("volume_limitations", source)),
        "per_volume": report.per_volume(files),
        "file_types": report.file_type_distribution(files),
        "provenance_flags": report.provenance_flags(files),
        "recovery": report.recovery_counts(files),
        "known_nsrl": report.nsrl_by_column(matches),
        "known_custom": report.custom_by_list(matches),
        "known_files": report.known_files_distinct(matches),
        "log_sources": report.log_by_source(log_rows),
        "log_inferred": report.log_inferred_counts(log_rows),
        "log_run": report.log_run_counts(log_rows, findings),
        "disclosures": findings.select("category", "subject", "detail").orderBy("category", "subject", "detail"),
        "search_breakdown": report.search_by_region_kind(hits),
        "search_run": report.search_run_counts(hits),
        "limitations": tables.read("volume_limitations", source).orderBy("volume_id", "volume_offset"),
        "coverage": report.coverage_statement(report.stages_covered(run_log, evidenced)),
        "timeline_head": top_n(events, schemas.ORDER_TIMELINE, 2000),
    }


def report_listings(tables: CaseTables, evidence_source_id: int | None = None) -> dict[str, tuple[DataFrame, list[str]]]:
    """The full listings of a report with their declared orders."""
    source = _source(tables, evidence_source_id)
    files = tables.read("files", source)
    matches = tables.read("known_file_matches", source)
    return {
        "timeline": (tables.read("timeline_events", source), schemas.ORDER_TIMELINE),
        "recovered": (report.recovered_files(files), schemas.ORDER_RECOVERED),
        "orphans": (report.orphan_files(files), schemas.ORDER_RECOVERED),
        "known": (known.with_file_columns(matches, files), schemas.ORDER_MATCHES),
        "search_hits": (tables.read("search_hits", source), schemas.ORDER_HITS),
    }


def write_sections(tables: CaseTables, folder: str, evidence_source_id: int | None = None) -> None:
    """Write every breakdown as one JSON file, and every listing as Parquet in order with positions."""
    write_report(report_sections(tables, evidence_source_id), folder)
    for name, (rows, order) in report_listings(tables, evidence_source_id).items():
        write_listing(rows, order, f"{folder}/listing_{name}")
