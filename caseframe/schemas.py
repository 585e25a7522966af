"""Table schemas, closed vocabularies and the declared total orders.

Surrogate insertion ids do not exist here: rows are identified by content keys,
and ``file_id`` is supplied with the inventory (unique per evidence source).
``attributes`` columns hold a JSON object with sorted keys.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*specs: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in specs])


_S, _L, _I, _B, _TS, _BIN = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.BooleanType(),
    T.TimestampType(),
    T.BinaryType(),
)

RUN = T.StructType([T.StructField("start", _L), T.StructField("len", _L)])

ENTRIES = _fields(
    ("evidence_source_id", _L, False),
    ("file_id", _L, False),
    ("volume_id", _L, False),
    ("volume_offset", _L, False),
    ("name", _S, False),
    ("path", _S, False),
    ("parent_addr", _L, True),
    ("meta_addr", _L, True),
    ("name_alloc", _B, True),
    ("meta_alloc", _B, True),
    ("meta_type_code", _I, True),
    ("name_type_code", _I, True),
    ("fs_type_code", _I, True),
    ("size", _L, True),
    ("uid", _I, True),
    ("gid", _I, True),
    ("mode", _I, True),
    ("mtime", _L, True),
    ("atime", _L, True),
    ("ctime", _L, True),
    ("crtime", _L, True),
    ("mtime_nano", _I, True),
    ("atime_nano", _I, True),
    ("ctime_nano", _I, True),
    ("crtime_nano", _I, True),
    ("content", _BIN, True),
)

FILES = _fields(
    ("evidence_source_id", _L, False),
    ("file_id", _L, False),
    ("volume_id", _L, False),
    ("volume_offset", _L, False),
    ("path", _S, False),
    ("name", _S, False),
    ("parent_addr", _L, True),
    ("meta_addr", _L, True),
    ("fs_type", _S, True),
    ("size", _L, True),
    ("allocated", _B, True),
    ("meta_type", _S, True),
    ("uid", _I, True),
    ("gid", _I, True),
    ("mode", _I, True),
    ("md5", _S, True),
    ("sha1", _S, True),
    ("sha256", _S, True),
    ("mtime_utc", _TS, True),
    ("atime_utc", _TS, True),
    ("ctime_utc", _TS, True),
    ("crtime_utc", _TS, True),
    ("timestamp_source", _S, True),
    ("file_type", _S, True),
    ("recovered", _B, True),
    ("confidence_tier", _S, True),
    ("recovered_path", _S, True),
    ("is_orphan", _B, True),
    ("attributes", _S, False),
)

INODES = _fields(
    ("volume_id", _L, False),
    ("volume_offset", _L, False),
    ("meta_addr", _L, False),
    ("size", _L, True),
    ("meta_type", _S, True),
    ("allocated", _B, True),
    ("orphan_flag", _B, True),
    ("now_allocated", _B, True),
    ("has_resident_data", _B, True),
    ("runs", T.ArrayType(RUN), True),
)

TIMELINE_EVENTS = _fields(
    ("evidence_source_id", _L, False),
    ("file_id", _L, True),
    ("ts_utc", _TS, False),
    ("is_undated", _B, False),
    ("source", _S, False),
    ("event_type", _S, False),
    ("volume_id", _L, False),
    ("volume_offset", _L, False),
    ("path", _S, False),
    ("meta_addr", _L, True),
    ("actor", _S, True),
    ("action", _S, True),
    ("outcome", _S, True),
    ("line_ord", _L, True),
    ("line_sub", _I, True),
    ("attributes", _S, False),
)

KNOWN_FILE_MATCHES = _fields(
    ("evidence_source_id", _L, False),
    ("file_id", _L, False),
    ("source", _S, False),
    ("list_name", _S, True),
    ("sense", _S, True),
    ("matched_on", _S, False),
)

SEARCH_HITS = _fields(
    ("evidence_source_id", _L, False),
    ("file_id", _L, True),
    ("region", _S, False),
    ("term", _S, False),
    ("term_kind", _S, False),
    ("volume_id", _L, False),
    ("volume_offset", _L, False),
    ("byte_offset", _L, True),
    ("block_index", _L, True),
    ("path", _S, True),
    ("context", _S, True),
    ("attributes", _S, False),
)

LOG_FINDINGS = _fields(
    ("evidence_source_id", _L, False),
    ("category", _S, False),
    ("subject", _S, True),
    ("detail", _S, True),
    ("present_indices", T.ArrayType(_L), True),
    ("missing_indices", T.ArrayType(_L), True),
    ("missing_ranges", T.ArrayType(T.StructType([T.StructField("first", _L), T.StructField("last", _L)])), True),
    ("member_count", _L, True),
)

VOLUME_LIMITATIONS = _fields(
    ("evidence_source_id", _L, False),
    ("volume_id", _L, True),
    ("volume_offset", _L, True),
    ("detected_desc", _S, True),
    ("reason", _S, True),
    ("attributes", _S, False),
)

CASES = _fields(
    ("case_id", _L, False),
    ("name", _S, False),
    ("examiner", _S, False),
    ("notes", _S, True),
    ("attributes", _S, False),
)

EVIDENCE_SOURCES = _fields(
    ("evidence_source_id", _L, False),
    ("case_id", _L, False),
    ("evidence_id", _S, False),
    ("path", _S, False),
    ("image_type", _S, False),
    ("sha256", _S, True),
    ("md5", _S, True),
    ("byte_size", _L, True),
    ("attributes", _S, False),
)

INTEGRITY_CHECKS = _fields(
    ("evidence_source_id", _L, False),
    ("check", _S, False),
    ("path", _S, False),
    ("supplied", _S, True),
    ("algorithm", _S, True),
    ("outcome", _S, False),
)

RUN_LOG = _fields(("case_id", _L, False), ("stage", _S, False))

TABLES: dict[str, T.StructType] = {
    "cases": CASES,
    "evidence_sources": EVIDENCE_SOURCES,
    "run_log": RUN_LOG,
    "files": FILES,
    "volume_limitations": VOLUME_LIMITATIONS,
    "log_findings": LOG_FINDINGS,
    "known_file_matches": KNOWN_FILE_MATCHES,
    "search_hits": SEARCH_HITS,
    "timeline_events": TIMELINE_EVENTS,
    "integrity_checks": INTEGRITY_CHECKS,
}

# Closed vocabularies (fixed values).
ENUMS: dict[str, dict[str, tuple[str, ...]]] = {
    "run_log": {"stage": ("recover", "filter", "logs", "search")},
    "search_hits": {
        "region": ("allocated", "unallocated", "metadata"),
        "term_kind": ("literal", "regex", "ioc", "hash"),
    },
    "known_file_matches": {
        "source": ("nsrl", "custom"),
        "sense": ("allow", "block"),
        "matched_on": ("md5", "sha1", "sha256"),
    },
    "log_findings": {"category": ("tamperability", "completeness")},
    "integrity_checks": {
        "check": ("acquisition", "reverify"),
        "outcome": ("PASS", "FAIL", "NOT_COMPARED", "MALFORMED", "changed", "appeared", "vanished"),
    },
    "files": {"confidence_tier": ("intact", "partial/overwritten")},
}

# Words that would turn provenance into a verdict; no column may carry one.
VERDICT_WORDS = ("verdict", "malicious", "clean", "good", "bad", "guilty")

# Declared total orders. Ascending with nulls first is Spark's default.
ORDER_TIMELINE = [
    "ts_utc",
    "volume_id",
    "volume_offset",
    "path",
    "event_type",
    "meta_addr",
    "source",
    "actor",
    "line_ord",
    "line_sub",
    "file_id",
]
ORDER_RECOVERED = ["mtime_utc", "volume_id", "volume_offset", "path", "meta_addr", "file_id"]
ORDER_MATCHES = [
    "volume_id",
    "volume_offset",
    "path",
    "file_id",
    "source",
    "list_name",
    "sense",
    "matched_on",
]
ORDER_HITS = [
    "volume_id",
    "volume_offset",
    "byte_offset",
    "term",
    "region",
    "term_kind",
    "path",
    "file_id",
]
