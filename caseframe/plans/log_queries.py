"""Log discovery, parsing, time resolution and the super-timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.functions import attributes, names, times
from caseframe.operators import ordered, report, timeline
from caseframe.operators.logs import discover, parse, resolve, years
from caseframe.plans.inventory_queries import EVENTS_SQL, NORMALIZED_SQL, normalized_files
from caseframe.plans.registry import iso_sql, query
from caseframe.plans.views import table, view
from caseframe.sources import text

LOG_ZONE = "Asia/Tokyo"
LOG_ZONE_SECONDS = 9 * 3600

BREAKS = "\\r\\n|[\\n\\r\\x{0b}\\x{0c}\\x{1c}\\x{1d}\\x{1e}\\x{85}\\x{2028}\\x{2029}]"
_LINES_SQL = f"""pieces AS (SELECT doc_id, string_split_regex(text, '{BREAKS}') AS p FROM documents),
  all_lines AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS line_no, len(p) AS n FROM pieces),
  doc_lines AS (SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM all_lines
    WHERE NOT (line_no = n - 1 AND line = ''))"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.lines_of(docs, F.col("text")).select("doc_id", F.col("line_ord").alias("line_no"), "line")


@query(
    "src_lines",
    f"WITH {_LINES_SQL} SELECT doc_id, line_no, line FROM doc_lines WHERE regexp_matches(line, '\\S')",
)
def src_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered non-blank lines of every document."""
    return parse.drop_blank(document_lines(spark, sf_dir))


LINE_PIECE = 4096


@query(
    "src_lines_pieces",
    f"WITH {_LINES_SQL} SELECT doc_id, line, CAST(COUNT(*) AS BIGINT) AS copies FROM doc_lines GROUP BY ALL",
)
def src_lines_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document read in pieces of 4 KiB."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(text as binary) as content")
    lines = text.lines_of_pieces(text.cut_pieces(docs, ["doc_id"], LINE_PIECE), ["doc_id"])
    return lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("copies"))


def _facts(lines: DataFrame) -> DataFrame:
    """A user's parser: facts of other types than text, one under a name that the analysis uses itself."""
    n = F.col("line_ord")
    facts = F.struct((n % 7).alias("number"), (n % 2 == 0).alias("even"), F.array(n, n + 1).alias("list"), F.lit("lost").alias("kind"))
    return lines.select("volume_id", "path", "line_ord", "line_sub", "line", facts.alias("extra"))


@query(
    "parser_attributes",
    """SELECT line_ord, line AS raw, '{"even":' || CAST(line_ord % 2 = 0 AS VARCHAR) || ',"kind":"facts","list":[' || line_ord || ',' || line_ord + 1
      || '],"number":' || line_ord % 7 || ',"rfc5424":false}' AS attributes FROM loglines_v WHERE path = '/var/log/messages'""",
    ("loglines_v",),
)
def parser_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plug-in parser adds arrives in the attributes with its type; the analysis's own flags win."""
    plug_in = parse.Parser("facts", lambda path: path.endswith("/messages"), records=_facts)
    records = parse.parse(view(spark, sf_dir, "loglines_v"), (plug_in,))
    flags = attributes.flags_json(kind=F.col("parser"), rfc5424=F.lit(False))
    return records.select("line_ord", "raw", attributes.merged(F.col("extra"), flags).alias("attributes"))


@query(
    "src_ioc_terms",
    f"""WITH {_LINES_SQL}, t AS (SELECT regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS term,
      struct_pack(d := doc_id, l := line_no) AS pos FROM doc_lines),
    firsts AS (SELECT term, MIN(pos) AS pos FROM t WHERE term <> '' AND NOT starts_with(term, '#') GROUP BY term)
    SELECT term, CAST(pos.d AS BIGINT) AS doc_id, CAST(pos.l AS BIGINT) AS line_no FROM firsts""",
)
def src_ioc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct indicators of a list with the position of their first line."""
    lines = document_lines(spark, sf_dir).select(F.struct("doc_id", "line_no").alias("line_no"), F.col("line").alias("value"))
    first = text.ioc_terms(lines)
    return first.select("term", "first_line.doc_id", F.col("first_line.line_no").cast("long").alias("line_no"))


_LEAF = "regexp_extract(path, '([^/]*)$', 1)"
_PARSER = (
    f"CASE WHEN starts_with({_LEAF}, 'auth.log') OR starts_with({_LEAF}, 'secure') THEN 'auth'"
    f" WHEN {_LEAF} IN ('.bash_history', '.zsh_history', '.history') THEN 'shell-history'"
    f" WHEN starts_with({_LEAF}, 'syslog') OR starts_with({_LEAF}, 'messages') THEN 'syslog' END"
)


@query("log_routing", f"SELECT file_id, path, {_LEAF} AS leaf, {_PARSER} AS parser FROM log_files_v", ("log_files_v",))
def log_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First parser in declared order that takes a path."""
    files = view(spark, sf_dir, "log_files_v")
    return files.select(
        "file_id", "path", names.leaf(F.col("path")).alias("leaf"), parse.route(F.col("path")).alias("parser")
    )


_BASE = "regexp_extract(leaf, '^(auth\\.log|secure|syslog|messages)(\\..*|-\\d{8}(\\.gz)?)?$', 1)"
MEMBERS_SQL = f"""leafed AS (SELECT *, {_LEAF} AS leaf FROM log_files_v),
  based AS (SELECT *, NULLIF({_BASE}, '') AS base,
    leaf IN ('.bash_history', '.zsh_history', '.history') AS is_history FROM leafed),
  kept AS (SELECT *, substr(leaf, length(base) + 1) AS rest FROM based WHERE base IS NOT NULL OR is_history),
  dated AS (SELECT *, NULLIF(regexp_extract(rest, '^[.-](\\d{{8}})(\\.gz)?$', 1), '') AS date_suffix FROM kept),
  members AS (SELECT *, CASE WHEN date_suffix IS NULL THEN
      COALESCE(TRY_CAST(NULLIF(regexp_extract(rest, '^\\.(\\d+)(\\.gz)?$', 1), '') AS BIGINT), 0) END AS rotation_index,
    NOT is_history AND ends_with(leaf, '.gz') AS is_gz,
    CASE WHEN is_history THEN path ELSE regexp_replace(path, '/?[^/]*$', '') || '/' || base END AS set_key,
    CASE WHEN is_history THEN path ELSE base END AS subject, {_PARSER} AS parser FROM dated)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.members(view(spark, sf_dir, "log_files_v"))


_MEMBER_COLUMNS = ["file_id", "volume_id", "path", "set_key", "subject", "rotation_index", "date_suffix", "is_gz", "is_history"]


@query("log_members", f"WITH {MEMBERS_SQL} SELECT {', '.join(_MEMBER_COLUMNS)} FROM members", ("log_files_v",))
def log_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotated log members and history files among the inventory."""
    return members(spark, sf_dir).select(_MEMBER_COLUMNS)


@query(
    "rotation_order",
    f"""WITH {MEMBERS_SQL}, u AS (SELECT DISTINCT volume_id, set_key, path, rotation_index, date_suffix, is_gz FROM members)
    SELECT volume_id, set_key, path, CAST(row_number() OVER (PARTITION BY volume_id, set_key ORDER BY
      COALESCE(rotation_index, 0) DESC, COALESCE(date_suffix, '99999999'), is_gz DESC, path) AS BIGINT) AS position
    FROM u""",
    ("log_files_v",),
)
def rotation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of each member, oldest to newest."""
    unique = members(spark, sf_dir).select("volume_id", "set_key", "path", "rotation_index", "date_suffix", "is_gz").distinct()
    return discover.with_rotation_position(unique).select("volume_id", "set_key", "path", "position")


COMPLETENESS_SQL = f"""completeness AS (
  SELECT evidence_source_id, volume_id, set_key, subject, is_history, COUNT(*) AS member_count,
    COALESCE(list_sort(list_distinct(list(rotation_index) FILTER (WHERE rotation_index IS NOT NULL))), []) AS present,
    MAX(rotation_index) AS top FROM members GROUP BY evidence_source_id, volume_id, set_key, subject, is_history),
  gaps AS (SELECT *, CASE WHEN top IS NULL THEN [] ELSE list_filter(range(0, top + 1), lambda i: NOT list_contains(present, i)) END AS missing
    FROM completeness),
  noted AS (SELECT *, array_to_string(present, ',') AS present_text, array_to_string(missing, ',') AS missing_text,
    array_to_string(list_transform(list_filter(range(1, len(present) + 1), lambda i: present[i] - CASE WHEN i = 1 THEN -1 ELSE present[i - 1] END > 1),
      lambda i: (CASE WHEN i = 1 THEN -1 ELSE present[i - 1] END + 1) || '-' || (present[i] - 1)), ',') AS range_text,
    CASE WHEN is_history THEN '{discover.NOTE_HISTORY}' WHEN len(missing) = 0 THEN '{discover.NOTE_COMPLETE}'
      ELSE 'log set may be incomplete: rotation indices [' || array_to_string(missing, ', ') ||
        '] absent (rotated out / never present)' END AS note FROM gaps)"""


@query(
    "rotation_completeness",
    f"""WITH {MEMBERS_SQL}, {COMPLETENESS_SQL} SELECT volume_id, set_key, subject, present_text AS present_indices,
      missing_text AS missing_indices, range_text AS missing_ranges, CAST(member_count AS BIGINT) AS member_count, note FROM noted""",
    ("log_files_v",),
)
def rotation_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present and missing rotation indices of each set."""
    return discover.completeness(members(spark, sf_dir)).select(
        "volume_id",
        "set_key",
        "subject",
        F.array_join("present_indices", ",").alias("present_indices"),
        F.array_join("missing_indices", ",").alias("missing_indices"),
        F.array_join(F.transform("missing_ranges", lambda g: F.concat_ws("-", g["first"], g["last"])), ",").alias("missing_ranges"),
        "member_count",
        "note",
    )


@query(
    "log_disclosures",
    f"""WITH {MEMBERS_SQL}, {COMPLETENESS_SQL}
    SELECT 'completeness' AS category, subject, note AS detail FROM noted
    UNION ALL SELECT DISTINCT 'tamperability', path, '{discover.TAMPERABILITY}' FROM members WHERE is_history""",
    ("log_files_v",),
)
def log_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings about the logs themselves."""
    return discover.disclosures(members(spark, sf_dir)).select("category", "subject", "detail")


# Files without a time stand elsewhere in the inventory.
_LISTED_PATH = "CASE WHEN mtime = 0 THEN '/lost' || path ELSE path END"


@query(
    "log_file_id",
    f"""WITH {MEMBERS_SQL}, first AS (SELECT evidence_source_id, {_LISTED_PATH} AS path, MIN(file_id) AS file_id FROM log_files_v GROUP BY 1, 2)
    SELECT m.volume_id, m.path, f.file_id FROM members m LEFT JOIN first f USING (evidence_source_id, path)""",
    ("log_files_v",),
)
def log_file_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First inventory id of a log path; NULL when the inventory lacks it."""
    inventory = view(spark, sf_dir, "log_files_v").withColumn("path", F.expr(_LISTED_PATH))
    return discover.with_file_id(members(spark, sf_dir), inventory).select("volume_id", "path", "file_id")


@query(
    "seed_year",
    f"""WITH {MEMBERS_SQL}, own AS (SELECT volume_id, path, MAX(mtime) AS own FROM log_files_v GROUP BY 1, 2),
    newest AS (SELECT volume_id, MAX(mtime) AS newest FROM log_files_v GROUP BY 1)
    SELECT path, volume_id, CAST(year(make_timestamp(CASE WHEN own <> 0 THEN own ELSE newest END * 1000000)) AS INT) AS seed_year,
      CASE WHEN own <> 0 THEN '{resolve.SEED_MEMBER}' ELSE '{resolve.SEED_NEWEST}' END AS seed_basis
    FROM members JOIN own USING (volume_id, path) JOIN newest USING (volume_id)""",
    ("log_files_v",),
)
def seed_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed year per member from its own or the newest modification time."""
    files = view(spark, sf_dir, "log_files_v")
    rows = resolve.seed_years(members(spark, sf_dir), files.select("volume_id", "path", "mtime"))
    return rows.select("path", "volume_id", "seed_year", "seed_basis")


_LINK = (
    "CASE c_nationkey % 6 WHEN 0 THEN '/usr/share/zoneinfo/America/New_York' WHEN 1 THEN '../usr/share/zoneinfo/Mars/Olympus'"
    " WHEN 2 THEN '/UTC' WHEN 3 THEN '/usr/share/zoneinfo/' ELSE NULL END"
)
_ZONE_TEXT = (
    "CASE c_mktsegment WHEN 'BUILDING' THEN '  Europe/Paris ' || chr(10) || 'x' WHEN 'AUTOMOBILE' THEN 'Bad/Zone'"
    " WHEN 'MACHINERY' THEN chr(10) || 'Asia/Tokyo' ELSE NULL END"
)


@query(
    "host_tz",
    f"""WITH c AS (SELECT c_custkey AS volume_id, {_LINK} AS link, {_ZONE_TEXT} AS zone_text FROM customer),
    z AS (SELECT volume_id, CASE WHEN contains(link, '/zoneinfo/') THEN regexp_extract(link, '/zoneinfo/(.*)$', 1)
        ELSE ltrim(link, '/') END AS l, trim(string_split(regexp_replace(zone_text, '^\\s+|\\s+$', '', 'g'), chr(10))[1]) AS t FROM c),
    v AS (SELECT *, l IN ('America/New_York', 'UTC') AS lok, t IN ('Europe/Paris', 'Asia/Tokyo') AS tok FROM z)
    SELECT volume_id, CASE WHEN lok THEN l WHEN tok THEN t END AS zone,
      CASE WHEN lok THEN 'etc-localtime' WHEN tok THEN 'etc-timezone' ELSE 'tz-undeterminable' END AS tz_resolution FROM v""",
)
def host_tz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone per volume from the link target, else the text file, else undeterminable."""
    customers = table(spark, sf_dir, "customer")
    config = customers.select(
        F.col("c_custkey").alias("volume_id"),
        F.explode(
            F.array(
                F.struct(F.lit("/etc/localtime").alias("path"), F.expr(_LINK).alias("link_target"), F.lit(None).cast("string").alias("text")),
                F.struct(F.lit("/etc/timezone").alias("path"), F.lit(None).cast("string").alias("link_target"), F.expr(_ZONE_TEXT).alias("text")),
            )
        ).alias("f"),
    ).select("volume_id", "f.*")
    return resolve.host_zones(config)


_R3164 = "^([A-Z][a-z]{2}\\s+\\d{1,2}\\s+\\d{2}:\\d{2}:\\d{2})\\s+(\\S+)\\s+([^\\s:\\[]+)(?:\\[(\\d+)\\])?:\\s?(.*)$"
_R5424 = "^<(\\d+)>1\\s+(\\S+)\\s+(\\S+)\\s+(\\S+)\\s+(\\S+)\\s+(\\S+)\\s+(?:-|\\[.*?\\])\\s+(.*)$"
_AUTH_CASES = (
    ("Accepted \\w+ for (?:invalid user )?(\\S+) from", "ssh-login", "success", True),
    ("Failed password for (?:invalid user )?(\\S+)", "ssh-login", "failure", True),
    ("authentication failure", "sudo", "denied", False),
    ("session opened for user (\\S+)", "session", "opened", True),
    ("session closed for user (\\S+)", "session", "closed", True),
    ("(\\S+) : .*COMMAND=(.*)", "sudo", "granted", True),
    ("\\b(?:new user|useradd)\\b", "account", "created", False),
)


def _auth_case(pick: str) -> str:
    token = "NULLIF(regexp_extract(message, '\\buser=(\\S+)', 1), '')"
    out = []
    for rx, action, outcome, has_user in _AUTH_CASES:
        user = f"COALESCE(NULLIF(regexp_extract(message, '{rx}', 1), ''), {token})" if has_user else token
        value = {"action": f"'{action}'", "outcome": f"'{outcome}'", "user": user}[pick]
        out.append(f"WHEN regexp_matches(message, '{rx}') THEN {value}")
    return f"CASE {' '.join(out)} ELSE {token if pick == 'user' else 'NULL'} END"


_ERRORS = "(?i)\\b(?:error|errors|failed|failure|fatal|critical|crit|panic|segfault|oom-kill|out of memory)\\b"
PARSED_SQL = f"""lines AS (SELECT *, {_PARSER} AS parser FROM loglines_v WHERE regexp_matches(line, '\\S')),
  headed AS (SELECT *, regexp_matches(line, '{_R5424}') AS m5, regexp_matches(line, '{_R3164}') AS m3 FROM lines),
  parsed AS (SELECT volume_id, path, line_ord, line_sub, line, parser,
    CASE WHEN m5 OR m3 THEN m5 END AS is_rfc5424,
    CASE WHEN m5 THEN regexp_extract(line, '{_R5424}', 4) WHEN m3 THEN regexp_extract(line, '{_R3164}', 3) END AS program,
    CASE WHEN m5 THEN regexp_extract(line, '{_R5424}', 3) WHEN m3 THEN regexp_extract(line, '{_R3164}', 2) END AS host,
    CASE WHEN m5 THEN CASE WHEN regexp_extract(line, '{_R5424}', 5) NOT IN ('-', '') THEN regexp_extract(line, '{_R5424}', 5) END
      WHEN m3 THEN NULLIF(regexp_extract(line, '{_R3164}', 4), '') END AS pid,
    CASE WHEN m5 THEN regexp_extract(line, '{_R5424}', 7) WHEN m3 THEN regexp_extract(line, '{_R3164}', 5) ELSE line END AS message,
    CASE WHEN m5 THEN regexp_extract(line, '{_R5424}', 2) WHEN m3 THEN regexp_extract(line, '{_R3164}', 1) END AS raw_timestamp
  FROM headed),
  classed AS (SELECT *,
    CASE WHEN is_rfc5424 IS NULL THEN NULL WHEN parser = 'auth' THEN {_auth_case('action')}
      WHEN program = 'kernel' THEN 'kernel' WHEN program IN ('CRON', 'cron', 'crond') THEN 'cron' ELSE 'service' END AS action,
    CASE WHEN is_rfc5424 IS NULL THEN NULL WHEN parser = 'auth' THEN {_auth_case('outcome')}
      WHEN regexp_matches(message, '{_ERRORS}') THEN 'error' END AS outcome,
    CASE WHEN is_rfc5424 IS NOT NULL AND parser = 'auth' THEN 'user=' || {_auth_case('user')} END AS actor
  FROM parsed),
  timed AS (SELECT *, CAST(list_position(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'],
      CASE WHEN NOT is_rfc5424 THEN substr(raw_timestamp, 1, 3) END) AS INT) AS month,
    CAST(NULLIF(regexp_extract(CASE WHEN NOT is_rfc5424 THEN raw_timestamp END, '^\\S+\\s+(\\d+)', 1), '') AS INT) AS day,
    CASE WHEN NOT is_rfc5424 THEN regexp_extract(raw_timestamp, '(\\S+)$', 1) END AS clock FROM classed)"""


def years_sql(source: str, key: str, order: str) -> str:
    """The window form of year inference over ``source`` (month, seed_year)."""
    desc = ", ".join(f"{c} DESC" for c in order.split(", "))
    w = f"PARTITION BY {key} ORDER BY {desc}"
    return f"""y_sym AS (SELECT *, CASE WHEN month <= 6 THEN 'L' WHEN older IS NULL OR older >= 7 OR month >= 11 THEN 'W' END AS sym
    FROM (SELECT *, lead(month) OVER ({w}) AS older FROM {source} WHERE month IS NOT NULL)),
  y_wrap AS (SELECT *, CASE WHEN sym = 'W' AND last_value(sym IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'L'
    THEN 1 ELSE 0 END AS wrap FROM y_sym),
  y_year AS (SELECT *, CAST(seed_year - SUM(wrap) OVER ({w} ROWS UNBOUNDED PRECEDING) AS INT) AS year FROM y_wrap)"""


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse(view(spark, sf_dir, "loglines_v"))


@query(
    "syslog_parse",
    f"""WITH {PARSED_SQL} SELECT line_ord, path, program, host, pid, message, raw_timestamp, is_rfc5424, month, day,
      TRY_CAST(substr(clock, 1, 2) AS INT) AS hour, TRY_CAST(substr(clock, 4, 2) AS INT) AS minute,
      TRY_CAST(substr(clock, 7, 2) AS INT) AS second FROM timed""",
    ("loglines_v",),
)
def syslog_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head grammar of every line; unmatched lines keep their text."""
    headed = parse.with_head(parse.drop_blank(view(spark, sf_dir, "loglines_v"))).withColumn(
        "epoch", F.lit(None).cast("long")
    )
    return resolve.with_components(headed).select(
        "line_ord", "path", "program", "host", "pid", "message", "raw_timestamp", "is_rfc5424",
        "month", "day", "hour", "minute", "second",
    )


@query(
    "auth_taxonomy",
    f"WITH {PARSED_SQL} SELECT line_ord, path, action, outcome, actor FROM classed WHERE parser = 'auth'",
    ("loglines_v",),
)
def auth_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action, outcome and user of authentication lines."""
    return log_records(spark, sf_dir).where("parser = 'auth'").select("line_ord", "path", "action", "outcome", "actor")


@query(
    "syslog_taxonomy",
    f"WITH {PARSED_SQL} SELECT line_ord, path, program, action, outcome FROM classed WHERE parser = 'syslog'",
    ("loglines_v",),
)
def syslog_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action by program and the error annotation of system lines."""
    return log_records(spark, sf_dir).where("parser = 'syslog'").select("line_ord", "path", "program", "action", "outcome")


@query(
    "shell_history",
    """WITH kept AS (SELECT *, NULLIF(regexp_extract(line, '^#(\\d{9,11})\\s*$', 1), '') AS marker
      FROM history_v WHERE regexp_matches(line, '\\S')),
    paired AS (SELECT *, lag(marker) OVER (PARTITION BY path ORDER BY line_ord, line_sub) AS pending,
      regexp_matches(line, '^:\\s*(\\d+):(\\d+);(.*)$') AS is_zsh FROM kept)
    SELECT path, line_ord, line_sub,
      CASE WHEN is_zsh THEN regexp_extract(line, '^:\\s*(\\d+):(\\d+);(.*)$', 3) ELSE line END AS message,
      CAST(CASE WHEN is_zsh THEN regexp_extract(line, '^:\\s*(\\d+):', 1) ELSE pending END AS BIGINT) AS epoch,
      'user=' || NULLIF(regexp_extract(path, '/home/([^/]+)/', 1), '') AS actor,
      CASE WHEN NOT is_zsh AND pending IS NULL THEN 'file-mtime-fallback; no per-line timestamp' END AS ts_basis,
      CASE WHEN ends_with(path, '.zsh_history') THEN 'zsh' ELSE 'bash' END AS kind
    FROM paired WHERE marker IS NULL""",
    ("history_v",),
)
def shell_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands with embedded times; a marker line dates the line after it."""
    return parse.history_records(view(spark, sf_dir, "history_v")).select(
        "path", "line_ord", "line_sub", "message", "epoch", "actor", "ts_basis", "kind"
    )


@query(
    "infer_years",
    f"""WITH rows AS (SELECT o_orderkey, o_custkey, o_orderdate, CAST(month(o_orderdate) AS INT) AS month,
      MAX(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS seed_year FROM orders),
    {years_sql('rows', 'o_custkey', 'o_orderdate, o_orderkey')}
    SELECT o_custkey, o_orderkey, month, year FROM y_year""",
)
def infer_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of year-less heads, per member, across segment edges."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("day_no"),
        "o_orderkey",
        F.month("o_orderdate").alias("month"),
        F.year("o_orderdate").alias("y"),
    )
    seeds = orders.groupBy("o_custkey").agg(F.max("y").alias("seed_year"))
    out = years.infer(orders.drop("y"), ["o_custkey"], ["day_no", "o_orderkey"], seeds, segment_rows=400)
    return out.select("o_custkey", "o_orderkey", "month", "year")


_MEMBER_ROWS = f"""member_rows AS (SELECT DISTINCT volume_id, path FROM loglines_v),
  seeds AS (SELECT volume_id, path, CASE WHEN volume_id = 2 THEN 1970 ELSE 2024 END AS seed_year,
    volume_id = 2 AS seed_unresolved, CASE WHEN volume_id = 0 THEN '{LOG_ZONE}' END AS zone,
    CASE WHEN volume_id = 0 THEN 'etc-localtime' ELSE 'tz-undeterminable' END AS tz_resolution,
    CASE WHEN volume_id = 2 THEN '{resolve.SEED_NONE}' WHEN path = '/var/log/secure' THEN '{resolve.SEED_NEWEST}'
      ELSE '{resolve.SEED_MEMBER}' END AS seed_basis FROM member_rows)"""
_SHIFT = f"CASE WHEN s.zone IS NULL THEN INTERVAL 0 SECOND ELSE INTERVAL {LOG_ZONE_SECONDS} SECOND END"
RESOLVED_SQL = f"""{PARSED_SQL}, {_MEMBER_ROWS},
  seeded AS (SELECT * FROM timed JOIN seeds USING (volume_id, path)),
  {years_sql('seeded', 'volume_id, path', 'line_ord, line_sub')},
  dated AS (SELECT s.*, y.year,
    CASE WHEN s.is_rfc5424 THEN 'offset' WHEN s.month IS NOT NULL THEN 'head' ELSE 'fallback' END AS way,
    CASE WHEN s.is_rfc5424 THEN CAST(substr(s.raw_timestamp, 1, 19) AS TIMESTAMP) - INTERVAL 2 HOUR END AS offset_ts,
    TRY_CAST(printf('%04d-%02d-%02d ', y.year, s.month, s.day) || s.clock AS TIMESTAMP) - {_SHIFT} AS head_ts,
    CAST(s.seed_year || '-01-01' AS TIMESTAMP) - {_SHIFT} AS fallback_ts
    FROM seeded s LEFT JOIN y_year y USING (volume_id, path, line_ord, line_sub)),
  resolved AS (SELECT *,
    CASE WHEN way = 'offset' THEN offset_ts WHEN seed_unresolved THEN NULL WHEN way = 'head' THEN head_ts ELSE fallback_ts END AS t,
    (way = 'head' AND head_ts IS NOT NULL) OR (way = 'fallback' AND NOT seed_unresolved) AS zoned,
    'log:' || CASE WHEN way = 'offset' THEN 'rfc5424-offset' WHEN NOT ((way = 'head' AND head_ts IS NOT NULL) OR (way = 'fallback' AND NOT seed_unresolved))
      THEN NULL WHEN zone IS NOT NULL THEN 'inferred-tz' ELSE 'assumed-utc' END AS timestamp_source FROM dated),
  flagged AS (SELECT *, COALESCE(t, TIMESTAMP '9999-12-31 23:59:59') AS ts_utc, t IS NULL AS is_undated,
    CASE WHEN zoned THEN zone END AS assumed_timezone,
    CASE WHEN zoned AND zone IS NULL THEN '{resolve.ASSUMED_UTC_WARNING}' END AS time_warning,
    CASE WHEN way = 'head' THEN year END AS year_inferred, CASE WHEN way <> 'offset' THEN seed_basis END AS year_basis,
    CASE WHEN way = 'head' AND head_ts IS NULL THEN '{resolve.IMPOSSIBLE_DATE_BASIS}'
      WHEN way = 'head' AND seed_unresolved THEN '{resolve.YEAR_UNRESOLVED_BASIS}'
      WHEN way = 'fallback' AND seed_unresolved THEN '{resolve.NO_TIME_BASIS}'
      WHEN way = 'fallback' THEN 'file-mtime-fallback; no per-line timestamp' END AS ts_basis,
    CASE WHEN way = 'head' AND seed_unresolved AND head_ts IS NOT NULL THEN {iso_sql('head_ts')} END AS ts_resolved
  FROM resolved),
  log_events AS (SELECT *, COALESCE(action, 'log') AS event_type, '{{' || concat_ws(',',
    '"assumed_timezone":' || CAST(to_json(assumed_timezone) AS VARCHAR), '"raw":' || CAST(to_json(line) AS VARCHAR),
    '"rfc5424":' || is_rfc5424, '"time_warning":' || CAST(to_json(time_warning) AS VARCHAR),
    '"timestamp_source":"' || timestamp_source || '"', '"ts_basis":' || CAST(to_json(ts_basis) AS VARCHAR),
    '"ts_resolved":"' || ts_resolved || '"', '"tz_resolution":"' || tz_resolution || '"',
    '"year_basis":' || CAST(to_json(year_basis) AS VARCHAR), '"year_inferred":' || year_inferred) || '}}' AS attributes
  FROM flagged)"""


def loglines_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the log lines with zone and seed; one volume has no times at all."""
    lines = view(spark, sf_dir, "loglines_v")
    found = discover.members(
        lines.select("volume_id", "path").distinct().withColumn("evidence_source_id", F.lit(1).cast("long"))
    )
    newest = table(spark, sf_dir, "events").agg(F.unix_timestamp(F.max("ts")).alias("t")).scalar()
    stamps = found.select(
        "volume_id",
        "path",
        F.when((F.col("volume_id") == 2) | (F.col("path") == "/var/log/secure"), F.lit(0)).otherwise(newest).cast("long").alias("mtime"),
    )
    seeded = resolve.seed_years(found, stamps)
    zone = F.when(F.col("volume_id") == 0, LOG_ZONE)
    return seeded.select(
        "evidence_source_id",
        "volume_id",
        "path",
        F.lit(0).cast("long").alias("volume_offset"),
        F.lit(None).cast("long").alias("file_id"),
        "seed_year",
        "seed_basis",
        "seed_unresolved",
        zone.alias("zone"),
        F.when(zone.isNotNull(), "etc-localtime").otherwise("tz-undeterminable").alias("tz_resolution"),
    )


def log_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve.resolve(log_records(spark, sf_dir), loglines_members(spark, sf_dir))
    return resolve.to_events(resolved)


@query(
    "log_resolve_time",
    f"""WITH {RESOLVED_SQL} SELECT path, line_ord, {iso_sql('ts_utc')} AS ts_utc, is_undated, parser AS source,
      event_type, actor, outcome, attributes FROM log_events""",
    ("loglines_v",),
)
def log_resolve_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log record dated, with the flags that say how."""
    return log_event_rows(spark, sf_dir).select(
        "path", "line_ord", times.iso_utc(F.col("ts_utc")).alias("ts_utc"), "is_undated", "source", "event_type",
        "actor", "outcome", "attributes",
    )


_MERGED_SQL = f"""WITH {RESOLVED_SQL}, {NORMALIZED_SQL}, {EVENTS_SQL}, merged AS (
  SELECT ts_utc, false AS is_undated, source, event_type, volume_id, volume_offset, path, meta_addr, actor,
    CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS line_ord, '{{}}' AS attributes FROM fs_events
  UNION ALL SELECT ts_utc, is_undated, parser, event_type, volume_id, 0, path, NULL, actor, action, outcome, line_ord, attributes
  FROM log_events)"""
_MERGED_COLUMNS = [
    "is_undated", "source", "event_type", "volume_id", "volume_offset", "path", "meta_addr", "actor", "action", "outcome", "line_ord",
]


def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.merge(
        timeline.macb_events(normalized_files(spark, sf_dir)), log_event_rows(spark, sf_dir)
    )


@query(
    "supertimeline",
    f"{_MERGED_SQL} SELECT {iso_sql('ts_utc')} AS ts_utc, {', '.join(_MERGED_COLUMNS)} FROM merged",
    ("entries_v", "loglines_v"),
)
def supertimeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filesystem and log events in one total order, undated events last."""
    files = timeline.macb_events(normalized_files(spark, sf_dir))
    logs = ordered.stored(log_event_rows(spark, sf_dir).drop("attributes"), "log-events")
    merged = timeline.merge(files, logs.withColumn("attributes", F.lit("{}")))
    return timeline.in_order(merged).select(times.iso_utc(F.col("ts_utc")).alias("ts_utc"), *_MERGED_COLUMNS)


@query(
    "log_by_source",
    f"""{_MERGED_SQL} SELECT source, CAST(COUNT(*) AS BIGINT) AS "count" FROM merged
    WHERE NOT starts_with(source, 'filesystem') GROUP BY 1""",
    ("entries_v", "loglines_v"),
)
def log_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events per source."""
    return report.log_by_source(merged_events(spark, sf_dir))


@query(
    "log_inferred_counts",
    f"""{_MERGED_SQL} SELECT CAST(COUNT(*) FILTER (WHERE attributes LIKE '%"year_inferred":%') AS BIGINT) AS inferred_year_count,
      CAST(COUNT(*) FILTER (WHERE attributes LIKE '%"assumed_timezone":%') AS BIGINT) AS inferred_timezone_count
    FROM merged WHERE NOT starts_with(source, 'filesystem')""",
    ("entries_v", "loglines_v"),
)
def log_inferred_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events that rest on an inferred year or zone."""
    return report.log_inferred_counts(merged_events(spark, sf_dir))


@query(
    "log_run_counts",
    f"""WITH {RESOLVED_SQL} SELECT CAST(COUNT(*) AS BIGINT) AS events_parsed,
      CAST(COUNT(*) FILTER (WHERE parser = 'auth') AS BIGINT) AS auth_events,
      (SELECT CAST(COUNT(DISTINCT CASE WHEN starts_with(path, '/var/log/auth') THEN 'auth' ELSE path END) AS BIGINT) FROM member_rows) AS log_sets,
      (SELECT CAST(COUNT(DISTINCT CASE WHEN starts_with(path, '/var/log/auth') THEN 'auth' ELSE path END) AS BIGINT) FROM member_rows) AS findings_count
    FROM log_events""",
    ("loglines_v",),
)
def log_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, authentication events, sets and findings of a log run."""
    lines = view(spark, sf_dir, "loglines_v")
    found = discover.members(
        lines.select("volume_id", "path").distinct().withColumn("evidence_source_id", F.lit(1).cast("long"))
    )
    return report.log_run_counts(log_event_rows(spark, sf_dir), discover.disclosures(found))
