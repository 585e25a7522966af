"""Log lines to records.

Input lines: volume_id, path, line_ord, line_sub, line. ``(line_ord,
line_sub)`` is the order inside a file; it need not be dense.

Records add: parser, message, raw_timestamp, program, host, pid, action,
outcome, actor, epoch, is_rfc5424, ts_basis, kind, and extra: a JSON object of
what a parser has to say besides, which goes into the event's attributes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.functions import names, syslog
from caseframe.operators import ordered
from caseframe.operators.logs import discover

RECORD_COLUMNS = [
    "volume_id",
    "path",
    "line_ord",
    "line_sub",
    "parser",
    "message",
    "raw",
    "raw_timestamp",
    "program",
    "host",
    "pid",
    "action",
    "outcome",
    "actor",
    "epoch",
    "is_rfc5424",
    "ts_basis",
    "kind",
    "extra",
]

_BLANK = r"(?U)^\s*$"


def drop_blank(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("line").rlike(_BLANK))


def with_head(lines: DataFrame) -> DataFrame:
    """Add the grammar fields; the regex runs once per line."""
    split = ordered.bind(lines, "_parts", syslog.head_parts(F.col("line")))
    fields = syslog.head_fields(F.col("_parts"), F.col("line"))
    return split.select(*lines.columns, *[c.alias(n) for n, c in fields.items()])


def _records(df: DataFrame, **extra: Column) -> DataFrame:
    types = {"epoch": "long", "is_rfc5424": "boolean"}
    columns = {**({} if "raw" in extra else {"raw": F.col("line")}), **extra}
    for c in RECORD_COLUMNS:
        if c not in columns:
            columns[c] = F.col(c) if c in df.columns else F.lit(None).cast(types.get(c, "string"))
    return df.select(*[columns[c].alias(c) for c in RECORD_COLUMNS])


def headed_records(lines: DataFrame, parsers: list[Parser]) -> DataFrame:
    """Records of all parsers that share the head grammar, in one pass over the lines.

    ``lines`` carries ``parser``. A line without a recognisable head keeps its
    text and gets no class.
    """
    headed = with_head(drop_blank(lines))
    program, message = F.col("program"), F.col("message")
    cls = syslog.no_class()
    for parser in parsers:
        ours = (F.col("parser") == parser.name) & F.col("is_rfc5424").isNotNull()
        cls = F.when(ours, parser.classify(program, message)).otherwise(cls)
    return _records(
        headed.withColumn("_class", cls),
        action=F.col("_class.action"),
        outcome=F.col("_class.outcome"),
        actor=F.col("_class.actor"),
    )


def history_records(lines: DataFrame) -> DataFrame:
    """A marker line dates the line after it; extended lines date themselves."""
    kept = ordered.bind(drop_blank(lines), "_marker", syslog.bash_marker_epoch(F.col("line")))
    paired = ordered.with_previous(
        kept, ["volume_id", "path"], ["line_ord", "line_sub"], ["_marker"], out="_prev"
    )
    rows = ordered.bind(paired.where("_marker is null"), "_zsh", syslog.zsh_fields(F.col("line")))
    extended = F.size("_zsh") == 3
    epoch = F.when(extended, F.get("_zsh", 0).try_cast("long")).otherwise(F.col("_prev._marker"))
    return _records(
        rows,
        parser=F.lit("shell-history"),
        message=F.when(extended, F.get("_zsh", 2)).otherwise(F.col("line")),
        actor=syslog.user_actor(names.home_owner(F.col("path"))),
        epoch=epoch,
        ts_basis=F.when(~extended & F.col("_prev._marker").isNull(), syslog.NO_TIMESTAMP_BASIS),
        kind=F.when(F.col("path").endswith(".zsh_history"), "zsh").otherwise("bash"),
    )


@dataclass(frozen=True)
class Parser:
    """A log parser: which paths it takes, and how lines become records.

    Give ``classify`` (program, message -> struct of action, outcome, actor)
    for lines with the common head, or ``records`` (lines -> records) for
    anything else; the latter may wrap a Python function with
    ``DataFrame.mapInPandas`` and gives the record columns that it has: lines
    without ``epoch`` or ``raw_timestamp`` are undated, and ``extra`` is a JSON
    object, a struct or a map whose values keep their type in the attributes.
    ``findings`` optionally maps the parser's members to finding rows.
    """

    name: str
    takes: Callable[[Column], Column]
    classify: Callable[[Column, Column], Column] | None = None
    records: Callable[[DataFrame], DataFrame] | None = None
    findings: Callable[[DataFrame], DataFrame] | None = None


def _leaf_starts(*prefixes: str) -> Callable[[Column], Column]:
    def takes(path: Column) -> Column:
        leaf = names.leaf(path)
        test = leaf.startswith(prefixes[0])
        for prefix in prefixes[1:]:
            test = test | leaf.startswith(prefix)
        return test

    return takes


PARSERS: tuple[Parser, ...] = (
    Parser(
        "auth",
        _leaf_starts("auth.log", "secure"),
        classify=lambda program, message: syslog.auth_class(message),
    ),
    Parser(
        "shell-history",
        lambda path: names.leaf(path).isin(*discover.HISTORY_LEAVES),
        records=history_records,
    ),
    Parser("syslog", _leaf_starts("syslog", "messages"), classify=syslog.syslog_class),
)


def route(path: Column, parsers: tuple[Parser, ...] = PARSERS) -> Column:
    """Name of the first parser that takes the path; NULL when none does."""
    expr = F.lit(None).cast("string")
    for parser in reversed(parsers):
        expr = F.when(parser.takes(path), parser.name).otherwise(expr)
    return expr


def _completed(records: DataFrame, name: str) -> DataFrame:
    """Records of a plug-in with the columns that it left out, and ``extra`` as JSON text."""
    given = records if "parser" in records.columns else records.withColumn("parser", F.lit(name))
    if "extra" in given.columns and given.schema["extra"].dataType.typeName() != "string":
        given = given.withColumn("extra", F.to_json("extra"))
    own = {c: F.col(c) for c in ("raw", "line") if c in given.columns}
    return _records(given, raw=own.get("raw", own.get("line", F.lit(None).cast("string"))))


def parse(lines: DataFrame, parsers: tuple[Parser, ...] = PARSERS) -> DataFrame:
    """Route every line by its path and parse it; lines nobody takes are skipped."""
    routed = lines.withColumn("parser", route(F.col("path"), parsers))
    headed = [p for p in parsers if p.classify is not None]
    parts = []
    if headed:
        mine = routed.where(F.col("parser").isin([p.name for p in headed]))
        parts.append(headed_records(mine, headed))
    for parser in parsers:
        if parser.records is not None:
            parts.append(_completed(parser.records(routed.where(F.col("parser") == parser.name)), parser.name))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
