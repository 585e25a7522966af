"""Byte-exact literal and regex scanning of one content value.

Content is decoded as ISO-8859-1, so one character is one byte and character
positions are byte offsets.
"""

from __future__ import annotations

import re
from re import _constants as sre_constants
from re import _parser as sre_parse

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT_RADIUS = 32
MAX_REGEX_SPAN = 4096


class PatternError(ValueError):
    """A search pattern that is invalid or could backtrack without bound."""


# A repeat of at least this many rounds counts as unbounded.
MANY_ROUNDS = 64

# Syntax on which Java and Python byte patterns agree. Everything else runs in
# Python.
_PORTABLE = re.compile(
    r"""(?x)
    (?: [A-Za-z0-9_@%&=:;,<>/~`'"!\- ]     # plain characters
      | [.^$|*+?]                          # operators
      | \\[dDwWsSnrt.\\+*?()\[\]{}|^$/\-]  # classes and escapes
      | \\x[0-7][0-9A-Fa-f]                # ASCII code points
      | \{\d+(?:,\d*)?\}                   # bounds
      | \(\?[:=!] | \((?!\?) | \)          # groups and lookahead
      | \[\^?(?:[^\[\]\\&~|]|\\[dDwWsSnrt.\\\-\]\[/])+\]
    )+"""
)


_REPEATS = (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT)


def _children(op, value) -> list:
    """The sub-patterns of one node of a parsed pattern."""
    if op in _REPEATS or op is getattr(sre_constants, "POSSESSIVE_REPEAT", None):
        return [value[2]]
    if op is sre_constants.SUBPATTERN:
        return [value[-1]]
    if op is sre_constants.BRANCH:
        return list(value[1])
    if op in (sre_constants.ASSERT, sre_constants.ASSERT_NOT):
        return [value[1]]
    if op is getattr(sre_constants, "ATOMIC_GROUP", None):
        return [value]
    if op is sre_constants.GROUPREF_EXISTS:
        return [x for x in value[1:] if x is not None]
    return []


def _can_explode(nodes, repeated: bool) -> bool:
    """Whether a choice of lengths, or of branches, lies inside a repeat of many rounds at any depth."""
    for op, value in nodes:
        varies = op in _REPEATS and value[0] != value[1] and value[1] >= MANY_ROUNDS
        if repeated and (varies or op is sre_constants.BRANCH):
            return True
        inside = repeated or (op in _REPEATS and value[1] >= MANY_ROUNDS)
        # A few rounds of an open repeat split the text between them as well.
        inside = inside or (op in _REPEATS and value[1] > 1 and value[0] != value[1])
        inside = inside or (op in _REPEATS and value[0] > 3)
        if any(_can_explode(child, inside) for child in _children(op, value)):
            return True
    return False


def _repeated_choice(pattern: str) -> bool:
    """Whether a group with alternatives is repeated without bound; the parser turns some into classes."""
    groups, in_class, k = [False], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            k += pattern[k + 1 : k + 2] == "^"
            k += pattern[k + 1 : k + 2] == "]"
        elif c == "(":
            groups.append(False)
        elif c == "|":
            groups[-1] = True
        elif c == ")" and len(groups) > 1 and groups.pop() and re.match(r"[*+]|\{\d*,\}", pattern[k + 1 :]):
            return True
        k += 1
    return False


def check_pattern(pattern: str) -> None:
    """Refuse invalid patterns and unbounded backtracking when the plan is built."""
    try:
        parsed = sre_parse.parse(pattern.encode("latin-1"))
        re.compile(pattern.encode("latin-1"))
    except (re.error, UnicodeEncodeError, OverflowError) as exc:
        raise PatternError(f"invalid pattern {pattern!r}: {exc}") from exc
    if _can_explode(parsed, False) or _repeated_choice(pattern):
        raise PatternError(f"pattern can backtrack without bound: {pattern!r}")


def _looks_around(nodes) -> bool:
    """Whether a match depends on bytes that are not its own."""
    around = (sre_constants.AT, sre_constants.ASSERT, sre_constants.ASSERT_NOT)
    return any(op in around or any(_looks_around(child) for child in _children(op, value)) for op, value in nodes)


def reach(pattern: str) -> int:
    """Bytes from its start that a match can depend on: its greatest length where the pattern tells one."""
    parsed = sre_parse.parse(pattern.encode("latin-1"))
    if _looks_around(parsed):
        return MAX_REGEX_SPAN
    return max(1, min(parsed.getwidth()[1], MAX_REGEX_SPAN))


def runs_in_jvm(pattern: str) -> bool:
    """True when the pattern means the same in Java and every match has a byte."""
    portable = _PORTABLE.fullmatch(pattern) is not None
    possessive = re.search(r"[*+?}]\+", pattern) is not None
    return portable and not possessive and sre_parse.parse(pattern.encode("latin-1")).getwidth()[0] > 0


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _quoted(literal: Column) -> Column:
    """Regex text that matches the literal only, for latin-1 text."""
    return F.regexp_replace(literal, r"([^A-Za-z0-9\x{0a}\x{80}-\x{ff}])", r"\\$1")


def _total(values: Column, start: Column, n: Column) -> Column:
    return F.aggregate(F.slice(values, start, n), F.lit(0).cast("long"), lambda a, x: a + x)


def _running_before(values: Column) -> Column:
    """Sum of the elements before each element.

    Totals are taken per block of about the square root of the length, so an
    element costs one partial block and the blocks before it.
    """

    def totals(v: Column, block: Column, sums: Column) -> Column:
        def before(x: Column, i: Column) -> Column:
            n = F.floor(i / block).cast("int")
            return _total(sums, F.lit(1), n) + _total(v, n * block + 1, i - n * block)

        return F.transform(v, before)

    def with_block(v: Column, block: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), block)
        return let(
            F.transform(starts, lambda at: _total(v, at + 1, block)), lambda sums: totals(v, block, sums)
        )

    return let(
        values,
        lambda v: let(
            F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1)), lambda block: with_block(v, block)
        ),
    )


def overlaps_itself(literal: bytes) -> bool:
    """True when an occurrence can start inside another one."""
    return any(literal[k:] == literal[:-k] for k in range(1, len(literal)))


def _java_literal(literal: bytes) -> str:
    text = literal.decode("latin-1")
    return "".join(ch if ch.isascii() and ch.isalnum() else f"\\x{ord(ch):02x}" for ch in text)


def fixed_literal_offsets(content: Column, literal: bytes) -> Column:
    """Offsets of every occurrence of a literal known when the plan is built."""
    if overlaps_itself(literal):
        return literal_offsets(content, F.lit(literal))
    text = F.decode(content, "ISO-8859-1")
    pieces = F.split(text, _java_literal(literal), -1)
    lengths = F.transform(pieces, lambda p: F.length(p).cast("long"))
    width = len(literal)
    # An occurrence ends where the next piece starts; no piece precedes the first.
    return let(
        lengths,
        lambda v: F.transform(
            F.slice(_running_before(v), F.lit(2), F.size(v)), lambda end, i: end + i * width
        ),
    )


def literal_offsets(content: Column, term: Column) -> Column:
    """Offsets of every occurrence of a byte literal, overlapping ones included.

    The text is cut in front of each occurrence; an occurrence starts where a
    piece starts, except that the first piece counts only if it is one.
    """
    text = F.decode(content, "ISO-8859-1")
    ahead = F.concat(F.lit("(?="), _quoted(F.decode(term, "ISO-8859-1")), F.lit(")"))
    lengths = F.transform(F.split(text, ahead, -1), lambda p: F.length(p).cast("long"))
    at_start = F.startswith(content, term)
    return let(
        _running_before(lengths),
        lambda starts: F.when(at_start, starts).otherwise(F.slice(starts, F.lit(2), F.size(starts))),
    )


def required_literal(pattern: str) -> bytes | None:
    """The longest literal every match must contain, if one can be told."""
    best = run = ""
    parsed = sre_parse.parse(pattern.encode("latin-1"))
    if parsed.state.flags & re.IGNORECASE:
        return None
    for op, value in parsed:
        if op is sre_constants.LITERAL:
            run += chr(value)
            best = max(best, run, key=len)
        else:
            run = ""
    return best.encode("latin-1") or None


def regex_spans(content: Column, pattern: str) -> Column:
    """Array of (offset, span) of the non-overlapping matches, left to right."""
    java = F.lit("(?d)" + pattern)
    text = F.decode(content, "ISO-8859-1")
    parts = F.struct(
        F.transform(F.split(text, java, -1), lambda p: F.length(p).cast("long")).alias("gaps"),
        F.transform(F.regexp_extract_all(text, java, F.lit(0)), lambda m: F.length(m).cast("long")).alias("spans"),
    )

    def spans(p: Column) -> Column:
        advance = F.transform(p["spans"], lambda n, i: n + F.get(p["gaps"], i))
        return let(
            _running_before(advance),
            lambda before: F.transform(
                p["spans"],
                lambda n, i: F.struct(
                    (F.get(before, i) + F.get(p["gaps"], i)).alias("offset"), n.alias("span")
                ),
            ),
        )

    return let(parts, spans)


def context(content: Column, offset: Column, span: Column) -> Column:
    """Up to 32 bytes on either side of a hit, as latin-1 text."""
    lo = F.greatest(offset - CONTEXT_RADIUS, F.lit(0))
    size = offset + F.least(span, F.lit(MAX_REGEX_SPAN)) + CONTEXT_RADIUS - lo
    return F.decode(F.substring(content, (lo + 1).cast("int"), size.cast("int")), "ISO-8859-1")


def cut_note(span: Column) -> Column:
    """Attributes of a hit: the true length of a match that is longer than its text."""
    return F.when(span > MAX_REGEX_SPAN, F.to_json(F.struct(span.alias("match_length")))).otherwise("{}")


def matched_text(content: Column, offset: Column, span: Column) -> Column:
    """The matched bytes as latin-1 text, at most 4096 of them."""
    size = F.least(span, F.lit(MAX_REGEX_SPAN))
    return F.decode(F.substring(content, (offset + 1).cast("int"), size.cast("int")), "ISO-8859-1")


SPANS = "array<struct<offset:bigint,span:bigint>>"


def python_spans(pattern: str):
    """Like ``regex_spans`` for patterns whose syntax or empty matches need Python."""

    @F.pandas_udf(SPANS)
    def spans(content: pd.Series) -> pd.Series:
        rx = re.compile(pattern.encode("latin-1"))

        def one(data: bytes | None) -> list[dict[str, int]]:
            found = rx.finditer(data) if data is not None else ()
            # An empty match at the very start has no extent and is not a hit.
            return [{"offset": m.start(), "span": m.end() - m.start()} for m in found if m.end() > 0]

        return content.map(one)

    return spans
