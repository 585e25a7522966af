"""Inventory, timestamps, digests, content types and the filesystem timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.functions import labels, signatures, times
from caseframe.operators import contents as pieced
from caseframe.operators import inventory, quality, timeline
from caseframe.plans.registry import iso_sql, query
from caseframe.plans.views import table, view

FAT_ZONE = "Asia/Kolkata"
MAX_HASH = 20000

_META_SQL = (
    "CASE meta_type_code WHEN 1 THEN 'reg' WHEN 2 THEN 'dir' WHEN 3 THEN 'fifo' WHEN 4 THEN 'chr'"
    " WHEN 5 THEN 'blk' WHEN 6 THEN 'lnk' WHEN 8 THEN 'sock' WHEN 10 THEN 'virt' WHEN 11 THEN 'virt_dir' END"
)
_NAME_SQL = (
    "CASE name_type_code WHEN 1 THEN 'fifo' WHEN 2 THEN 'chr' WHEN 3 THEN 'dir' WHEN 4 THEN 'blk'"
    " WHEN 5 THEN 'reg' WHEN 6 THEN 'lnk' WHEN 7 THEN 'sock' WHEN 10 THEN 'virt' WHEN 11 THEN 'virt_dir' END"
)
_FS_SQL = "CASE fs_type_code WHEN 8192 THEN 'ext' WHEN 1 THEN 'ntfs' WHEN 4 THEN 'fat' ELSE 'unknown' END"


def macb_sql(col: str, nano: str) -> str:
    """UTC instant of one stamp; FAT readings are shifted by the fixed zone offset."""
    shift = "CASE WHEN fs_type_code = 4 THEN 19800 ELSE 0 END"
    return (
        f"CASE WHEN meta_addr IS NOT NULL AND {col} <> 0 AND {col} BETWEEN -62135596800 AND 253402300799 "
        f"THEN make_timestamp(({col} - {shift}) * 1000000 + COALESCE({nano}, 0) // 1000) END"
    )


NORMALIZED_SQL = f"""normalized AS (
  SELECT *, {_FS_SQL} AS fs_type, COALESCE({_META_SQL}, {_NAME_SQL}, 'unknown') AS meta_type,
    COALESCE(name_alloc, false) AND COALESCE(meta_alloc, false) AS allocated,
    {macb_sql('mtime', 'mtime_nano')} AS mtime_utc,
    {macb_sql('atime', 'atime_nano')} AS atime_utc,
    {macb_sql('ctime', 'ctime_nano')} AS ctime_utc,
    {macb_sql('crtime', 'crtime_nano')} AS crtime_utc
  FROM entries_v)"""

EVENTS_SQL = """fs_events AS (
  SELECT evidence_source_id, file_id, ts_utc, 'filesystem:' || fs_type AS source, event_type,
    volume_id, volume_offset, path, meta_addr,
    CASE WHEN gid IS NULL THEN 'uid=' || uid ELSE 'uid=' || uid || ',gid=' || gid END AS actor
  FROM (SELECT *, mtime_utc AS ts_utc, 'modified' AS event_type FROM normalized
        UNION ALL SELECT *, atime_utc, 'accessed' FROM normalized
        UNION ALL SELECT *, ctime_utc, 'changed' FROM normalized
        UNION ALL SELECT *, crtime_utc, 'born' FROM normalized)
  WHERE ts_utc IS NOT NULL)"""


def normalized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows as far as the timeline needs them."""
    entries = view(spark, sf_dir, "entries_v")
    return inventory.with_macb(inventory.with_labels(inventory.with_allocation(entries)), FAT_ZONE)


@query(
    "src_entries",
    f"""WITH {NORMALIZED_SQL}
    SELECT file_id, volume_id, path, fs_type, meta_type, allocated, size, uid, gid,
      CASE WHEN meta_addr IS NULL THEN NULL WHEN fs_type = 'ext' THEN 'ext4:inode'
        WHEN fs_type = 'ntfs' THEN 'ntfs:$STANDARD_INFORMATION' WHEN fs_type = 'fat' THEN 'fat:dir-entry' END
        AS timestamp_source
    FROM normalized""",
    ("entries_v",),
)
def src_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory source with labels and the allocation rule."""
    entries = view(spark, sf_dir, "entries_v")
    return inventory.with_labels(inventory.with_allocation(entries)).select(
        "file_id", "volume_id", "path", "fs_type", "meta_type", "allocated", "size", "uid", "gid", "timestamp_source"
    )


@query(
    "label_maps",
    f"""SELECT fs_type_code, meta_type_code, name_type_code, {_FS_SQL} AS fs_type,
      COALESCE({_META_SQL}, {_NAME_SQL}, 'unknown') AS meta_type,
      CASE COALESCE({_META_SQL}, {_NAME_SQL}, 'unknown') WHEN 'dir' THEN 'directory' WHEN 'lnk' THEN 'symlink' END
        AS structural_type,
      CAST(COUNT(*) AS BIGINT) AS entries
    FROM entries_v GROUP BY ALL""",
    ("entries_v",),
)
def label_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code to label maps with the name-type fallback, counted per combination."""
    entries = view(spark, sf_dir, "entries_v")
    counted = entries.groupBy("fs_type_code", "meta_type_code", "name_type_code").agg(
        F.count(F.lit(1)).alias("entries")
    )
    meta = labels.meta_type_label(F.col("meta_type_code"), F.col("name_type_code"))
    return counted.select(
        "fs_type_code",
        "meta_type_code",
        "name_type_code",
        labels.fs_type_label(F.col("fs_type_code")).alias("fs_type"),
        meta.alias("meta_type"),
        labels.structural_type(meta).alias("structural_type"),
        "entries",
    )


_ISO4 = ", ".join(f"{iso_sql(c)} AS {c}" for c in ("mtime_utc", "atime_utc", "ctime_utc", "crtime_utc"))


@query(
    "macb_utc",
    f"WITH {NORMALIZED_SQL} SELECT file_id, path, {_ISO4} FROM normalized",
    ("entries_v",),
)
def macb_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four UTC instants per entry; zero and out-of-range epochs are NULL."""
    return normalized_files(spark, sf_dir).select(
        "file_id", "path", *[times.iso_utc(F.col(f"{c}_utc")).alias(f"{c}_utc") for c in inventory.MACB]
    )


@query(
    "macb_fat_rebase",
    f"""WITH {NORMALIZED_SQL}
    SELECT file_id, path, mtime, {iso_sql('mtime_utc')} AS mtime_utc,
      'local-time-inferred' AS time_precision, '{FAT_ZONE}' AS assumed_timezone
    FROM normalized WHERE fs_type = 'fat' AND meta_addr IS NOT NULL""",
    ("entries_v",),
)
def macb_fat_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local wall-clock stamps re-read in the assumed zone, flagged."""
    fat = normalized_files(spark, sf_dir).where("fs_type = 'fat' and meta_addr is not null")
    return fat.select(
        "file_id",
        "path",
        "mtime",
        times.iso_utc(F.col("mtime_utc")).alias("mtime_utc"),
        F.lit("local-time-inferred").alias("time_precision"),
        F.lit(FAT_ZONE).alias("assumed_timezone"),
    )


@query(
    "content_digests",
    "SELECT doc_id AS file_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents",
)
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three digests of every content in one scan."""
    docs = table(spark, sf_dir, "documents").withColumn("content", F.col("text").cast("binary"))
    return docs.select(
        F.col("doc_id").alias("file_id"),
        F.md5("content").alias("md5"),
        F.sha1("content").alias("sha1"),
        F.sha2("content", 256).alias("sha256"),
    )


DIGEST_PIECE = 4096


@query(
    "chunk_digests",
    f"""WITH d AS (SELECT doc_id AS object_id, text, strlen(text) AS size, doc_id % 7 = 0 AND strlen(text) > {DIGEST_PIECE} AS short FROM documents)
    SELECT object_id, CAST(size AS BIGINT) AS size, CAST(CASE WHEN short THEN {DIGEST_PIECE} ELSE size END AS BIGINT) AS read_length,
      CASE WHEN NOT short THEN md5(text) END AS md5, CASE WHEN NOT short THEN sha1(text) END AS sha1,
      CASE WHEN NOT short THEN sha256(text) END AS sha256, CASE WHEN short THEN 'short_read' END AS hash_skipped FROM d""",
)
def chunk_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of contents stored in pieces; of every seventh the second piece is lost."""
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id as object_id", "cast(text as binary) as content", "cast(octet_length(text) as bigint) as size"
    )
    count = F.expr(f"cast((size - 1) div {DIGEST_PIECE} as int)")
    cut = docs.where("size > 0").select("object_id", "content", F.explode(F.sequence(F.lit(0), count)).alias("no"))
    pieces = cut.where("object_id % 7 <> 0 or no <> 1").select(
        "object_id",
        (F.col("no") * F.lit(DIGEST_PIECE).cast("long")).alias("base"),
        F.substring(F.col("content"), F.col("no") * DIGEST_PIECE + 1, F.lit(DIGEST_PIECE)).alias("data"),
    )
    return pieced.chunk_digests(pieces, docs.select("object_id", "size"), ["object_id"])


_SKIP_SQL = f"""WITH e AS (
  SELECT file_id, meta_type, COALESCE(allocated, false) AS allocated,
    CASE WHEN file_id % 29 = 0 THEN NULL ELSE content_text END AS content,
    CASE WHEN file_id % 19 = 0 THEN size + 1 ELSE size END AS size
  FROM files_v), r AS (
  SELECT *, CASE WHEN meta_type = 'reg' AND allocated THEN
      CASE WHEN size > {MAX_HASH} THEN 'exceeds_max_hash_size' WHEN content IS NULL THEN 'read_error'
           WHEN strlen(content) <> size THEN 'short_read' END END AS hash_skipped
  FROM e)
SELECT file_id, hash_skipped,
  CASE WHEN meta_type = 'reg' AND allocated AND hash_skipped IS NULL THEN sha256(content) END AS sha256,
  CASE WHEN meta_type = 'dir' THEN 'directory' WHEN content IS NULL THEN NULL ELSE 'text/plain' END AS file_type,
  CASE WHEN meta_type = 'reg' AND NOT allocated AND content IS NOT NULL
    THEN 'unallocated-blocks-may-be-reused' END AS file_type_provenance
FROM r"""


@query("digest_skip", _SKIP_SQL, ("files_v",))
def digest_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a content has no digest, its type, and the unallocated-typing flag."""
    entries = view(spark, sf_dir, "files_v").select(
        "file_id",
        "meta_type",
        F.coalesce("allocated", F.lit(False)).alias("allocated"),
        F.when(F.col("file_id") % 29 != 0, F.col("content_text").cast("binary")).alias("content"),
        (F.col("size") + F.when(F.col("file_id") % 19 == 0, 1).otherwise(0)).alias("size"),
    )
    return inventory.with_content_fields(entries, MAX_HASH).select(
        "file_id", "hash_skipped", "sha256", "file_type", "file_type_provenance"
    )


_TYPE_CASE = (
    "CASE WHEN strlen(content) = 0 THEN 'inode/x-empty'"
    " WHEN starts_with(content, '%PDF-') THEN 'application/pdf' WHEN starts_with(content, 'MZ') THEN 'application/x-dosexec'"
    " WHEN starts_with(content, 'BZh') THEN 'application/x-bzip2' WHEN starts_with(content, 'GIF87a') THEN 'image/gif'"
    " WHEN starts_with(content, 'GIF89a') THEN 'image/gif' WHEN starts_with(content, '#!') THEN 'text/x-shellscript'"
    " WHEN starts_with(content, '<?xml') THEN 'text/xml' WHEN starts_with(content, '<!DOCTYPE html') THEN 'text/html'"
    " WHEN starts_with(content, '<!doctype html') THEN 'text/html' WHEN starts_with(content, '<html') THEN 'text/html'"
    " ELSE CASE WHEN regexp_matches(looked_at, '[\\x00-\\x06\\x0e-\\x1a\\x1c-\\x1f\\x7f]') THEN 'application/octet-stream'"
    " ELSE 'text/plain' END END"
)
_CONTENTS_SQL = (
    "contents AS (SELECT 'document' AS origin, doc_id AS object_id, text AS content FROM documents"
    " UNION ALL SELECT 'page', page_id, html FROM pages"
    " UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations)"
)


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, pages and conversation turns as binary objects."""
    docs = table(spark, sf_dir, "documents").selectExpr("'document' as origin", "doc_id as object_id", "cast(text as binary) as content")
    pages = table(spark, sf_dir, "pages").selectExpr("'page' as origin", "page_id as object_id", "cast(html as binary) as content")
    turns = table(spark, sf_dir, "conversations").selectExpr("'turn' as origin", "conv_id * 1000 + turn as object_id", "cast(text as binary) as content")
    return docs.unionByName(pages).unionByName(turns)


#: Leading bytes that are put before the contents of two thirds of the documents: every signature and container marker.
HEADS = [
    *[(bytes(at) + magic, mime, None) for at, magic, mime in signatures.SIGNATURES],
    *[(bytes(0 if window == len(marker) else 3) + marker, None, hint) for window, marker, hint in signatures.CONTAINER_MARKERS],
]
HEAD_CYCLE = 3 * len(HEADS) // 2


def _value(text: str | None) -> str:
    return "NULL" if text is None else f"'{text}'"


_HEADS_SQL = "heads AS (SELECT * FROM (VALUES " + ", ".join(
    f"({k}, {len(head)}, {'true' if b'\0' in head else 'false'}, {_value(mime)}, {_value(hint)})" for k, (head, mime, hint) in enumerate(HEADS)
) + ") v(k, head_size, head_opaque, head_type, hint))"


# What is looked at is the first 4096 bytes; characters beyond ASCII stand for as many bytes.
@query(
    "file_type_sig",
    f"""WITH {_CONTENTS_SQL}, {_HEADS_SQL},
    joined AS (SELECT origin, object_id, content, head_type, hint, head_size, head_opaque,
        substring(regexp_replace(regexp_replace(regexp_replace(content, '[\\x{{80}}-\\x{{7ff}}]', '??', 'g'), '[\\x{{800}}-\\x{{ffff}}]', '???', 'g'),
          '[\\x{{10000}}-\\x{{10ffff}}]', '????', 'g'), 1, {signatures.HEAD_BYTES} - coalesce(head_size, 0)) AS looked_at
      FROM contents LEFT JOIN heads ON origin = 'document' AND object_id % {HEAD_CYCLE} = k)
    SELECT origin, object_id, CASE WHEN head_type IS NOT NULL THEN head_type WHEN head_size IS NULL THEN {_TYPE_CASE}
      WHEN head_opaque OR regexp_matches(looked_at, '[\\x00-\\x06\\x0e-\\x1a\\x1c-\\x1f\\x7f]') THEN 'application/octet-stream' ELSE 'text/plain' END AS file_type,
      hint AS encryption_hint FROM joined""",
)
def file_type_sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content type by signature and container hint of every object; every signature occurs."""
    heads = F.array(*[F.lit(head) for head, _, _ in HEADS])
    head = F.when(F.col("origin") == "document", F.get(heads, (F.col("object_id") % HEAD_CYCLE).cast("int")))
    rows = contents(spark, sf_dir).withColumn("content", F.concat(F.coalesce(head, F.lit(b"")), F.col("content")))
    return rows.select(
        "origin",
        "object_id",
        signatures.file_type(F.col("content")).alias("file_type"),
        signatures.container_hint(F.col("content")).alias("encryption_hint"),
    )


_EVENT_COLUMNS = ["source", "event_type", "volume_id", "volume_offset", "path", "meta_addr", "actor", "file_id"]


@query(
    "timeline_macb",
    f"""WITH {NORMALIZED_SQL}, {EVENTS_SQL}
    SELECT {iso_sql('ts_utc')} AS ts_utc, {', '.join(_EVENT_COLUMNS)} FROM fs_events""",
    ("entries_v",),
)
def timeline_macb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filesystem timeline: unpivot of the recorded stamps in the declared total order."""
    events = timeline.in_order(timeline.macb_events(normalized_files(spark, sf_dir)))
    return events.select(times.iso_utc(F.col("ts_utc")).alias("ts_utc"), *_EVENT_COLUMNS)


@query(
    "timeline_positions",
    f"""WITH {NORMALIZED_SQL}, {EVENTS_SQL}
    SELECT row_number() OVER (ORDER BY ts_utc NULLS FIRST, volume_id, volume_offset, path, event_type,
        meta_addr NULLS FIRST, source, actor NULLS FIRST, file_id) AS position,
      {iso_sql('ts_utc')} AS ts_utc, {', '.join(_EVENT_COLUMNS)} FROM fs_events""",
    ("entries_v",),
)
def timeline_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with their position in the total order, counted in parallel."""
    events = timeline.macb_events(normalized_files(spark, sf_dir))
    listed = timeline.positions(events)
    return listed.select("position", times.iso_utc(F.col("ts_utc")).alias("ts_utc"), *_EVENT_COLUMNS)


@query(
    "timeline_top_n",
    f"""WITH {NORMALIZED_SQL}, {EVENTS_SQL}, ranked AS (
      SELECT *, row_number() OVER (ORDER BY ts_utc NULLS FIRST, volume_id, volume_offset, path, event_type,
        meta_addr NULLS FIRST, source, actor NULLS FIRST, file_id) AS position FROM fs_events)
    SELECT position, {iso_sql('ts_utc')} AS ts_utc, {', '.join(_EVENT_COLUMNS)},
      (SELECT CAST(COUNT(*) AS BIGINT) FROM fs_events) AS total,
      (SELECT COUNT(*) FROM fs_events) > 2000 AS truncated
    FROM ranked WHERE position <= 2000""",
    ("entries_v",),
)
def timeline_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 2000 events of the total order with the true total."""
    first = timeline.first_n(timeline.macb_events(normalized_files(spark, sf_dir)), 2000)
    return first.select(
        "position", times.iso_utc(F.col("ts_utc")).alias("ts_utc"), *_EVENT_COLUMNS, "total", "truncated"
    )


_ROW_TEXT = (
    "concat_ws('|', strftime(ts_utc, '%Y-%m-%dT%H:%M:%S.%f'), source, event_type, volume_id, volume_offset, path,"
    " COALESCE(CAST(meta_addr AS VARCHAR), ''), COALESCE(actor, ''), file_id)"
)


@query(
    "report_digest",
    f"""WITH {NORMALIZED_SQL}, {EVENTS_SQL}
    SELECT CAST(COUNT(*) AS BIGINT) AS rows,
      CAST(SUM(CAST('0x' || substr(sha256({_ROW_TEXT}), 1, 15) AS BIGINT)) AS VARCHAR) AS digest
    FROM fs_events""",
    ("entries_v",),
)
def report_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free digest of the filesystem timeline."""
    events = timeline.macb_events(normalized_files(spark, sf_dir))
    text = F.concat_ws(
        "|",
        F.date_format("ts_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        "source",
        "event_type",
        "volume_id",
        "volume_offset",
        "path",
        F.coalesce(F.col("meta_addr").cast("string"), F.lit("")),
        F.coalesce("actor", F.lit("")),
        "file_id",
    )
    return quality.result_digest(events, text)
