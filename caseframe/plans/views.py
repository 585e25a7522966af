"""Evidence-shaped views over the given star-schema and text tables.

A view is a base table and a list of expressions over its columns, written once
in the part of SQL that Spark and DuckDB share; the few functions that differ
go through a dialect object.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Spark:
    """Spark spellings."""

    @staticmethod
    def epoch(ts: str) -> str:
        return f"unix_timestamp({ts})"

    @staticmethod
    def sha256(x: str) -> str:
        return f"sha2({x}, 256)"

    @staticmethod
    def bytes_of(x: str) -> str:
        return f"CAST(octet_length({x}) AS BIGINT)"

    @staticmethod
    def div(a: str, b: str) -> str:
        return f"({a}) div ({b})"

    @staticmethod
    def head_time(ts: str) -> str:
        return f"date_format({ts}, 'MMM dd HH:mm:ss')"

    @staticmethod
    def iso_time(ts: str) -> str:
        return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss\")"

    @staticmethod
    def instant(secs: str) -> str:
        return f"timestamp_seconds({secs})"

    @staticmethod
    def one_line(x: str) -> str:
        return f"replace({x}, chr(10), ' ')"


class Duck:
    """DuckDB spellings."""

    @staticmethod
    def epoch(ts: str) -> str:
        return f"CAST(epoch({ts}) AS BIGINT)"

    @staticmethod
    def sha256(x: str) -> str:
        return f"sha256({x})"

    @staticmethod
    def bytes_of(x: str) -> str:
        return f"CAST(strlen({x}) AS BIGINT)"

    @staticmethod
    def div(a: str, b: str) -> str:
        return f"({a}) // ({b})"

    @staticmethod
    def head_time(ts: str) -> str:
        return f"strftime({ts}, '%b %d %H:%M:%S')"

    @staticmethod
    def iso_time(ts: str) -> str:
        return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"

    @staticmethod
    def instant(secs: str) -> str:
        return f"make_timestamp(({secs}) * 1000000)"

    @staticmethod
    def one_line(x: str) -> str:
        return f"replace({x}, chr(10), ' ')"


Dialect = type[Spark] | type[Duck]


def _files(d: Dialect) -> list[str]:
    regular = "doc_id % 11 <> 0"
    return [
        "CAST(CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS BIGINT) AS evidence_source_id",
        "doc_id AS file_id",
        "doc_id % 3 AS volume_id",
        "(doc_id % 3) * 1048576 AS volume_offset",
        "'/' || lang || '/' || source || '/' || doc_id || '.txt' AS path",
        "doc_id || '.txt' AS name",
        "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE doc_id + 10 END AS meta_addr",
        "CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'ext'"
        " WHEN doc_id % 3 = 1 THEN 'ntfs' ELSE 'fat' END AS fs_type",
        f"{d.bytes_of('text')} AS size",
        "CASE WHEN doc_id % 23 = 0 THEN NULL ELSE doc_id % 5 <> 0 END AS allocated",
        f"CASE WHEN {regular} THEN 'reg' ELSE 'dir' END AS meta_type",
        "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 1000 END AS uid",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 100 + doc_id % 5 END AS gid",
        f"CASE WHEN {regular} AND doc_id % 4 <> 1 THEN md5(text) END AS md5",
        f"CASE WHEN {regular} AND doc_id % 4 <> 2 THEN sha1(text) END AS sha1",
        f"CASE WHEN {regular} THEN {d.sha256('text')} END AS sha256",
        f"CASE WHEN doc_id % 10 <> 0 THEN {d.instant('946684800 + doc_id * 3600')} END AS mtime_utc",
        "CASE WHEN doc_id % 10 = 0 THEN true ELSE NULL END AS recovered",
        "CASE WHEN doc_id % 10 <> 0 THEN NULL WHEN doc_id % 40 = 0 THEN true"
        " WHEN doc_id % 40 = 10 THEN NULL ELSE false END AS is_orphan",
        "CASE WHEN doc_id % 10 <> 0 THEN NULL WHEN doc_id % 30 = 0 THEN 'partial/overwritten'"
        " ELSE 'intact' END AS confidence_tier",
        "CASE WHEN doc_id % 3 = 2 AND doc_id % 13 <> 0 THEN"
        " '{\"assumed_timezone\":\"Asia/Kolkata\",\"time_precision\":\"local-time-inferred\"}'"
        " WHEN doc_id % 5 = 0 THEN"
        " '{\"file_type_provenance\":\"unallocated-blocks-may-be-reused\"}' ELSE '{}' END AS attributes",
        "text AS content_text",
    ]


def _entries(d: Dialect) -> list[str]:
    mtime = d.epoch("l_shipdate")
    return [
        "CAST(1 AS BIGINT) AS evidence_source_id",
        "l_orderkey * 8 + l_linenumber AS file_id",
        "l_suppkey % 4 AS volume_id",
        "(l_suppkey % 4) * 1048576 AS volume_offset",
        "'o' || l_orderkey || '.' || l_linenumber AS name",
        "'/p' || l_partkey || '/o' || l_orderkey || '.' || l_linenumber AS path",
        "l_partkey AS parent_addr",
        "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_orderkey END AS meta_addr",
        "l_returnflag <> 'R' AS name_alloc",
        "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_linestatus = 'F' END AS meta_alloc",
        "CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_linenumber AS INT) END AS meta_type_code",
        "CAST(l_partkey % 12 AS INT) AS name_type_code",
        "CAST(CASE l_suppkey % 4 WHEN 0 THEN 8192 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 99 END AS INT)"
        " AS fs_type_code",
        "CAST(l_quantity AS BIGINT) * 100 AS size",
        "CAST(l_suppkey AS INT) AS uid",
        "CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(100 + l_linenumber AS INT) END AS gid",
        "CAST(420 AS INT) AS mode",
        f"{mtime} AS mtime",
        f"{mtime} + CAST(l_quantity AS BIGINT) * 3600 AS atime",
        f"CASE WHEN l_returnflag = 'N' THEN 0 ELSE {mtime} END AS ctime",
        f"CASE WHEN l_linenumber = 7 THEN {mtime} + 300000000000 ELSE {mtime} - 86400 END AS crtime",
        "CAST((l_partkey % 1000) * 1000999 AS INT) AS mtime_nano",
        "CAST(0 AS INT) AS atime_nano",
        "CAST(999 AS INT) AS ctime_nano",
        "CAST(NULL AS INT) AS crtime_nano",
    ]


def _loglines(d: Dialect) -> list[str]:
    user = "'u' || user_id"
    body = (
        "CASE event_type"
        f" WHEN 'error' THEN 'sudo: pam_unix(sudo:auth): authentication failure; logname= uid=1000 user=' || {user}"
        f" WHEN 'click' THEN 'sshd[' || event_id || ']: Accepted password for ' || {user} || ' from 10.0.0.1 port 22'"
        f" WHEN 'view' THEN 'sshd[' || event_id || ']: Failed password for invalid user ' || {user} || ' from 10.0.0.2'"
        f" WHEN 'signup' THEN 'CRON[' || event_id || ']: pam_unix(cron:session): session opened for user ' || {user}"
        f" ELSE 'kernel: oom-kill of ' || {user} || ' ' || props END"
    )
    host = "' host' || user_id % 4 || ' '"
    return [
        "CAST(CASE user_id % 5 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS BIGINT) AS volume_id",
        "CASE user_id % 5 WHEN 0 THEN '/var/log/auth.log' WHEN 1 THEN '/var/log/auth.log.1'"
        " WHEN 2 THEN '/var/log/secure' WHEN 3 THEN '/var/log/syslog' ELSE '/var/log/messages' END AS path",
        "event_id AS line_ord",
        "CAST(0 AS INT) AS line_sub",
        "CASE WHEN event_id % 97 = 0 THEN 'garbage ' || props"
        f" WHEN event_id % 89 = 0 THEN '<34>1 ' || {d.iso_time('ts')} || '+02:00 host9 app ' || CASE WHEN event_id % 2 = 0 THEN '-' ELSE '77' END || ' ID47 - ' || event_type"
        " WHEN event_id % 83 = 0 THEN '   '"
        f" WHEN event_id % 79 = 0 THEN 'Feb 30 10:00:00' || {host} || 'sshd: impossible'"
        f" ELSE {d.head_time('ts')} || {host} || {body} END AS line",
    ]


def _history(d: Dialect) -> list[str]:
    text = d.one_line("text")
    return [
        "CAST(0 AS BIGINT) AS volume_id",
        "CASE WHEN conv_id % 5 = 4 THEN '/root/' ELSE '/home/user' || conv_id || '/' END ||"
        " CASE WHEN conv_id % 3 = 0 THEN '.zsh_history' ELSE '.bash_history' END AS path",
        "conv_id * 4096 + turn AS line_ord",
        "CAST(0 AS INT) AS line_sub",
        "CASE WHEN role = 'user' AND conv_id % 3 <> 0 THEN '#' || (1700000000 + conv_id * 1000 + turn)"
        f" WHEN role = 'assistant' AND conv_id % 3 = 0 THEN ': ' || (1700000000 + conv_id * 1000 + turn) || ':0;' || {text}"
        f" ELSE {text} END AS line",
    ]


def _inodes(d: Dialect) -> list[str]:
    return [
        "o_custkey % 2 AS volume_id",
        "(o_custkey % 2) * 1048576 AS volume_offset",
        "o_orderkey AS meta_addr",
        "CASE WHEN o_orderkey % 41 = 0 THEN CAST(0 AS BIGINT) ELSE (1 + o_orderkey % 8) * 512 END AS size",
        "CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 10 = 0 THEN 'dir' ELSE 'reg' END AS meta_type",
        "o_orderstatus <> 'F' AS allocated",
        "o_orderkey % 43 = 0 AS orphan_flag",
        "o_orderstatus = 'F' AND o_orderkey % 37 = 0 AS now_allocated",
        "o_orderkey % 31 = 0 AS has_resident_data",
        "o_orderkey * 3 AS run_start",
        "CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 31 = 0 THEN CAST(0 AS BIGINT) ELSE 1 + o_orderkey % 8 END AS run_len",
    ]


def _dir_entries(d: Dialect) -> list[str]:
    return [
        "o_custkey % 2 AS volume_id",
        "(o_custkey % 2) * 1048576 AS volume_offset",
        # Urgent orders are names without an inode.
        "CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderkey END AS meta_addr",
        "'f' || o_orderkey || '.dat' AS name",
        "'/d' || o_custkey || '/f' || o_orderkey || '.dat' AS path",
        "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_custkey END AS parent_addr",
        "o_orderstatus <> 'F' AS allocated",
        "CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 10 = 0 THEN 'dir' ELSE 'reg' END AS meta_type",
        "o_orderkey AS entry_ordinal",
    ]


def _log_files(d: Dialect) -> list[str]:
    folder = "'/h' || " + d.div("p_partkey", "12") + " || '/var/log/'"
    return [
        "CAST(1 AS BIGINT) AS evidence_source_id",
        "p_partkey AS file_id",
        "p_partkey % 2 AS volume_id",
        f"{folder} || CASE p_partkey % 8 WHEN 0 THEN 'auth.log' WHEN 1 THEN 'syslog'"
        " WHEN 2 THEN 'auth.log.' || (1 + p_size % 9) WHEN 3 THEN 'messages.' || (1 + p_size % 12) || '.gz'"
        " WHEN 4 THEN 'auth.log.' || (2 + p_size) || '.gz' WHEN 5 THEN 'messages-2024010' || (1 + p_size % 9)"
        " WHEN 6 THEN 'dpkg.log' ELSE 'home/user' || p_partkey || '/.bash_history' END AS path",
        "CASE WHEN p_partkey % 9 = 0 THEN CAST(0 AS BIGINT) ELSE 1600000000 + p_partkey * 40000 END AS mtime",
    ]


VIEWS: dict[str, tuple[str, Callable[[Dialect], list[str]]]] = {
    "files_v": ("documents", _files),
    "entries_v": ("lineitem", _entries),
    "loglines_v": ("events", _loglines),
    "history_v": ("conversations", _history),
    "inodes_v": ("orders", _inodes),
    "dir_entries_v": ("orders", _dir_entries),
    "log_files_v": ("part", _log_files),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; unused columns are pruned down to the scan."""
    base, exprs = VIEWS[name]
    return table(spark, sf_dir, base).selectExpr(*exprs(Spark))


def view_sql(name: str) -> str:
    """The view as DuckDB text."""
    base, exprs = VIEWS[name]
    return f"SELECT {', '.join(exprs(Duck))} FROM {base}"
