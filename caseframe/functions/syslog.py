"""Log line grammars and taxonomies as column expressions.

Each grammar is evaluated by one regex pass: the groups are rewritten into a
newline-separated record (a log line never contains a newline) and split again,
so a line that does not match stays a single field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line grammars. (?U) gives the Unicode classes of text patterns.
RFC3164 = (
    r"(?U)^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+"
    r"([^\s:\[]+)(?:\[(\d+)\])?:\s?(.*)$"
)
RFC5424 = r"(?U)^<(\d+)>1\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:-|\[.*?\])\s+(.*)$"

# Month abbreviations of a year-less head.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Authentication shapes in order of precedence, as
# (words that must occur, pattern, user group or 0, action, outcome).
AUTH_SHAPES: tuple[tuple[tuple[str, ...], str, int, str, str], ...] = (
    (("Accepted ",), r"(?U)Accepted \w+ for (?:invalid user )?(\S+) from", 1, "ssh-login", "success"),
    (("Failed password for ",), r"(?U)Failed password for (?:invalid user )?(\S+)", 1, "ssh-login", "failure"),
    (("authentication failure",), r"authentication failure", 0, "sudo", "denied"),
    (("session opened for user ",), r"(?U)session opened for user (\S+)", 1, "session", "opened"),
    (("session closed for user ",), r"(?U)session closed for user (\S+)", 1, "session", "closed"),
    ((" : ", "COMMAND="), r"(?U)(\S+) : .*COMMAND=(.*)", 1, "sudo", "granted"),
    ((), r"(?U)\b(?:new user|useradd)\b", 0, "account", "created"),
)
USER_TOKEN = r"(?U)\buser=(\S+)"

# Scheduled-job programs and words that name an error.
CRON_PROGRAMS = ("CRON", "cron", "crond")
ERROR_WORDS = r"(?iU)\b(?:error|errors|failed|failure|fatal|critical|crit|panic|segfault|oom-kill|out of memory)\b"

# Shell history line shapes.
ZSH_EXTENDED = r"(?U)^:\s*(\d+):(\d+);(.*)$"
BASH_MARKER = r"(?U)^#(\d{9,11})\s*$"
NO_TIMESTAMP_BASIS = "file-mtime-fallback; no per-line timestamp"


def _groups(line: Column, pattern: str, n: int) -> Column:
    record = "\n".join(f"${i}" for i in range(1, n + 1))
    return F.split(F.regexp_replace(line, F.lit(pattern), F.lit(record)), "\n", n)


def head_parts(line: Column) -> Column:
    """Fields of the line: 7 for the modern grammar, 5 for the classic one, else 1."""
    return F.when(line.startswith("<"), _groups(line, RFC5424, 7)).otherwise(_groups(line, RFC3164, 5))


def head_fields(parts: Column, line: Column) -> dict[str, Column]:
    """Named fields of ``head_parts``; an unmatched line is all message."""
    modern, classic = F.size(parts) == 7, F.size(parts) == 5

    def pick(i7: int, i5: int) -> Column:
        return F.when(modern, F.get(parts, i7 - 1)).when(classic, F.get(parts, i5 - 1))

    return {
        "program": pick(4, 3),
        "host": pick(3, 2),
        "pid": F.when(modern, F.when(~F.get(parts, 4).isin("-", ""), F.get(parts, 4))).when(
            classic, F.nullif(F.get(parts, 3), F.lit(""))
        ),
        "message": F.coalesce(pick(7, 5), line),
        "raw_timestamp": pick(2, 1),
        "is_rfc5424": F.when(modern | classic, modern),
    }


_HEAD_TIME = rf"(?U)^\s*({'|'.join(MONTHS)})\s+(\d+)\s+(\d+):(\d+):(\d+)(?:\s.*)?$"


def head_time_parts(raw_timestamp: Column) -> Column:
    """Month name, day, hour, minute, second of a year-less head; size 1 if it is none."""
    return _groups(raw_timestamp, _HEAD_TIME, 5)


def head_time_fields(parts: Column) -> dict[str, Column]:
    """Numbers of ``head_time_parts``; all NULL unless every one is there."""
    complete = F.size(parts) == 5
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.get(parts, 0)).cast("int")
    fields = {"month": F.when(complete, month)}
    for i, name in enumerate(("day", "hour", "minute", "second"), start=1):
        fields[name] = F.when(complete, F.get(parts, i).try_cast("int"))
    return fields


def _shape_matches(message: Column, words: tuple[str, ...], pattern: str) -> Column:
    """Cheap substring tests first, the regex only behind them."""
    test = message.rlike(pattern)
    for word in reversed(words):
        test = F.contains(message, F.lit(word)) & test
    return test


def _class(action, outcome, actor) -> Column:
    def text(v: Column | str | None) -> Column:
        return v if isinstance(v, Column) else F.lit(v).cast("string")

    return F.struct(text(action).alias("action"), text(outcome).alias("outcome"), text(actor).alias("actor"))


def no_class() -> Column:
    return _class(None, None, None)


def user_actor(user: Column) -> Column:
    """``user=<name>`` or NULL, never a literal for an unknown user."""
    return F.when(F.coalesce(user, F.lit("")) != "", F.concat(F.lit("user="), user))


def auth_class(message: Column) -> Column:
    """Struct of action, outcome, actor; the first matching shape decides."""
    token = user_actor(F.regexp_extract(message, USER_TOKEN, 1))
    expr = None
    for words, pattern, group, action, outcome in AUTH_SHAPES:
        # A user group cannot match nothing, so the shape itself names the user.
        actor = (
            F.concat(F.lit("user="), F.regexp_extract(message, pattern, group)) if group else token
        )
        test = _shape_matches(message, words, pattern)
        row = _class(action, outcome, actor)
        expr = F.when(test, row) if expr is None else expr.when(test, row)
    return expr.otherwise(_class(None, None, token))


def syslog_class(program: Column, message: Column) -> Column:
    """Struct of action (by program), outcome (``error`` if a word names one), no actor."""
    outcome = F.when(message.rlike(ERROR_WORDS), "error")
    action = (
        F.when(program.isNull(), F.lit(None).cast("string"))
        .when(program == "kernel", "kernel")
        .when(program.isin(*CRON_PROGRAMS), "cron")
        .otherwise("service")
    )
    return _class(action, outcome, None)


def zsh_fields(line: Column) -> Column:
    """Array (start, elapsed, command) of an extended history line, else size 1."""
    return _groups(line, ZSH_EXTENDED, 3)


def bash_marker_epoch(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, BASH_MARKER, 1), F.lit("")).try_cast("long")
