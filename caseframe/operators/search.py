"""Content search with byte offsets.

``search_objects`` scans whole contents without a shuffle: all terms and
patterns are applied to a row in one pass. ``search_chunks`` scans content that
is stored in pieces, or that is too large for one row: pieces are regrouped into
fixed windows with a margin on both sides, and a hit belongs to the window in
which it starts, so it is found once and sees its full surroundings.

Contents are binary. Terms are bytes; hits carry them as latin-1 text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseframe.functions import scan
from caseframe.operators import chunk_regex, term_table
from caseframe.schemas import SEARCH_HITS

WINDOW = 1 << 20

# Up to this many literals get an expression of their own in the plan; a longer
# list is searched as a table of terms. The hits are the same.
MAX_PLAN_TERMS = 64

Literal = tuple[bytes, str]

_HITS = "array<struct<term_kind:string,offset:bigint,span:bigint>>"


def _literal_hits(content: Column, literal: Literal) -> Column:
    term, kind = literal
    offsets = F.when(F.contains(content, F.lit(term)), scan.fixed_literal_offsets(content, term))
    return F.transform(
        offsets,
        lambda o: F.struct(
            F.lit(kind).alias("term_kind"), o.alias("offset"), F.lit(len(term)).cast("long").alias("span")
        ),
    )


def _as_regex_hits(spans: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            F.lit("regex").alias("term_kind"), s["offset"].alias("offset"), s["span"].alias("span")
        ),
    )


def _regex_hits(content: Column, pattern: str) -> Column:
    needed = scan.required_literal(pattern)
    possible = F.lit(True) if needed is None else F.contains(content, F.lit(needed))
    if scan.runs_in_jvm(pattern):
        text = F.decode(content, "ISO-8859-1")
        spans = F.when(possible & text.rlike("(?d)" + pattern), scan.regex_spans(content, pattern))
    else:
        # Rows without the literal send nothing to Python.
        spans = scan.python_spans(pattern)(F.when(possible, content))
    return _as_regex_hits(spans)


def _terms_frame(df: DataFrame, literals: Sequence[Literal]) -> DataFrame:
    rows = [(bytearray(t), k) for t, k in literals]
    return df.sparkSession.createDataFrame(rows, "term binary, kind string")


def _with_text(df: DataFrame) -> DataFrame:
    """Rows with content, term_kind, offset, span: adds term, context and attributes."""
    content, offset, span = F.col("content"), F.col("offset"), F.col("span")
    literal = F.decode(F.substring(content, (offset + 1).cast("int"), span.cast("int")), "ISO-8859-1")
    found = F.when(F.col("term_kind") == "regex", scan.matched_text(content, offset, span)).otherwise(literal)
    note = F.when(F.col("term_kind") == "regex", scan.cut_note(span)).otherwise("{}")
    return df.withColumns({"term": found, "context": scan.context(content, offset, span), "attributes": note})


def _exploded(df: DataFrame, literals: Sequence[Literal], regexes: Sequence[str]) -> DataFrame:
    """Rows of ``df`` without content times their hits, with term, offset, span, context and attributes."""
    content = F.col("content")
    kept = [literal for literal in dict.fromkeys(literals) if literal[0]]
    arms = [_literal_hits(content, literal) for literal in kept] if len(kept) <= MAX_PLAN_TERMS else []
    for pattern in regexes:
        scan.check_pattern(pattern)
        arms.append(_regex_hits(content, pattern))
    if not kept and not arms:
        raise ValueError("no term and no pattern given")
    out = None
    if arms:
        hits = F.concat(*[F.coalesce(a, F.array().cast(_HITS)) for a in arms])
        out = _with_text(
            df.withColumn("_h", F.explode(hits)).select(
                *df.columns,
                F.col("_h.term_kind").alias("term_kind"),
                F.col("_h.offset").alias("offset"),
                F.col("_h.span").alias("span"),
            )
        )
    if len(kept) > MAX_PLAN_TERMS:
        listed = term_table.table_hits(df, _terms_frame(df, kept))
        out = listed if out is None else out.drop("content").unionByName(listed)
    return out.drop("content")


def searchable(files: DataFrame) -> DataFrame:
    """Allocated regular files with content."""
    return files.where("meta_type = 'reg' and allocated and size > 0 and content is not null")


def _as_hits(df: DataFrame, region: str, byte_offset: Column, block_index: Column) -> DataFrame:
    optional = {
        "evidence_source_id": "long",
        "file_id": "long",
        "path": "string",
        "volume_id": "long",
        "volume_offset": "long",
    }
    columns = {
        "region": F.lit(region),
        "term": F.col("term"),
        "term_kind": F.col("term_kind"),
        "byte_offset": byte_offset,
        "block_index": block_index,
        "context": F.col("context"),
        "attributes": F.col("attributes"),
    }
    for name, kind in optional.items():
        columns[name] = F.col(name) if name in df.columns else F.lit(None).cast(kind)
    return df.select(*[columns[n].alias(n) for n in SEARCH_HITS.fieldNames()])


def search_objects(
    objects: DataFrame, literals: Sequence[Literal] = (), regexes: Sequence[str] = ()
) -> DataFrame:
    """Hits in whole contents; offsets are relative to the content."""
    found = _exploded(objects, literals, regexes)
    return _as_hits(found, "allocated", F.col("offset"), F.lit(None).cast("long"))


def cut_windows(chunks: DataFrame, keys: list[str], margin: int, window: int = WINDOW) -> DataFrame:
    """Chunks (keys, base, data) regrouped into windows of contiguous content.

    Adds ``window_no`` and ``_object``, one name for all keys (of which some may
    be null); ``base`` is the offset of the first byte of ``content``.
    A group is one window of one key with its margins, so its size is fixed. A
    gap between chunks ends a stretch of content, so nothing matches across it.
    """
    end = F.col("base") + F.octet_length("data")
    first = F.greatest(F.floor((F.col("base") - margin) / window), F.lit(0))
    last = F.floor((F.col("base") + F.octet_length("data") + (margin - 1)) / window)
    named = F.unhex(F.md5(F.to_json(F.struct(*[F.col(k) for k in keys])).cast("binary")))
    named = F.coalesce(named, F.lit(b""))  # never null, which spares a filter that would keep arms from sharing an exchange
    spread = chunks.where(F.octet_length("data") > 0).select(
        named.alias("_object"), *keys, "base", end.alias("_end"), "data", F.explode(F.sequence(first, last)).alias("window_no")
    )
    lo = F.greatest(F.col("base"), F.col("window_no") * window - margin)
    hi = F.least(F.col("_end"), (F.col("window_no") + 1) * window + margin)
    pieces = (
        spread.withColumns({"_lo": lo, "_hi": hi})
        .where("_lo < _hi")
        .select(
            "_object",
            *keys,
            "window_no",
            "_lo",
            "_hi",
            F.expr("substring(data, cast(_lo - base + 1 as int), cast(_hi - _lo as int))").alias("data"),
        )
    )
    w = W.partitionBy("_object", "window_no").orderBy("_lo")
    gap = F.coalesce((F.col("_lo") != F.lag("_hi").over(w)).cast("int"), F.lit(0))
    stretches = pieces.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(w))
    text = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_lo", F.decode("data", "ISO-8859-1").alias("t")))),
            lambda p: p["t"],
        ),
        "",
    )
    return (
        stretches.groupBy("_object", "window_no", "_run", *keys)
        .agg(F.min("_lo").alias("base"), F.encode(text, "ISO-8859-1").alias("content"))
        .drop("_run")
    )


def margin_for(literals: Sequence[Literal], regexes: Sequence[str]) -> int:
    """Bytes a window needs on either side: the longest match and its context."""
    longest = max([len(t) for t, _ in literals] + [scan.MAX_REGEX_SPAN if regexes else 1])
    return longest - 1 + scan.CONTEXT_RADIUS


def _pattern_hits(windows: DataFrame, pattern: str, size: int) -> DataFrame:
    found = chunk_regex.regex_hits(windows, pattern, size).withColumn("term_kind", F.lit("regex"))
    return _with_text(found).drop("content")


def search_chunks(
    chunks: DataFrame,
    keys: list[str],
    literals: Sequence[Literal] = (),
    regexes: Sequence[str] = (),
    window: int = WINDOW,
    terms: DataFrame | None = None,
) -> DataFrame:
    """Hits in chunked content: keys, term, term_kind, byte_offset, context, attributes.

    ``terms`` (term binary, kind string) adds a list of any length. A match of a
    pattern is seen as far as ``MAX_REGEX_SPAN`` bytes from its start; windows
    share as many bytes as the patterns of a call can reach.
    """
    for pattern in regexes:
        scan.check_pattern(pattern)
    reaches = [scan.reach(pattern) - 1 + scan.CONTEXT_RADIUS for pattern in regexes]
    margin = max([margin_for(literals, ()), *reaches])
    if terms is not None:
        longest = terms.agg(F.coalesce(F.max(F.octet_length("term")), F.lit(1))).first()[0]
        margin = max(margin, longest - 1 + scan.CONTEXT_RADIUS)
    size = max(window, 2 * margin)
    windows = cut_windows(chunks, keys, margin, size)
    arms = [_pattern_hits(windows, pattern, size) for pattern in dict.fromkeys(regexes)]
    if any(t for t, _ in literals):
        arms.append(_exploded(windows, literals, ()))
    if terms is not None:
        arms.append(term_table.table_hits(windows, terms))
    if not arms:
        raise ValueError("no term and no pattern given")
    found = arms[0]
    for arm in arms[1:]:
        found = found.unionByName(arm)
    found = found.withColumn("byte_offset", F.col("base") + F.col("offset"))
    # Literals are found in the margins as well; matches of patterns start in their window.
    mine = (F.col("term_kind") == "regex") | (F.expr(f"byte_offset div {size}") == F.col("window_no"))
    return found.where(mine).select(*keys, "term", "term_kind", "byte_offset", "context", "attributes")


def search_file_chunks(
    chunks: DataFrame,
    literals: Sequence[Literal] = (),
    regexes: Sequence[str] = (),
    window: int = WINDOW,
    terms: DataFrame | None = None,
) -> DataFrame:
    """Hits in files too large for one row, stored as chunks with file columns, base and data."""
    keys = [c for c in SEARCH_HITS.fieldNames() if c in chunks.columns]
    found = search_chunks(chunks, keys, literals, regexes, window, terms)
    return _as_hits(found, "allocated", F.col("byte_offset"), F.lit(None).cast("long"))


def search_blocks(
    blocks: DataFrame,
    block_size: int,
    literals: Sequence[Literal] = (),
    regexes: Sequence[str] = (),
    window: int = WINDOW,
    terms: DataFrame | None = None,
) -> DataFrame:
    """Hits in unallocated blocks (volume_id, volume_offset, block_index, data).

    Offsets are absolute; only runs of adjacent blocks are read as one.
    """
    keys = [c for c in ("evidence_source_id", "volume_id", "volume_offset") if c in blocks.columns]
    chunks = blocks.select(
        *keys, (F.col("volume_offset") + F.col("block_index") * block_size).alias("base"), "data"
    )
    found = search_chunks(chunks, keys, literals, regexes, window, terms)
    index = F.expr(f"(byte_offset - volume_offset) div {int(block_size)}")
    return _as_hits(found, "unallocated", F.col("byte_offset"), index)


def search_term_table(objects: DataFrame, terms: DataFrame, context: bool = True) -> DataFrame:
    """Literal hits in whole contents for a term table (term binary, kind string) of any length.

    Without ``context`` hits have none, which spares the bytes around them.
    """
    found = term_table.table_hits(objects, terms, context)
    return _as_hits(found, "allocated", F.col("offset"), F.lit(None).cast("long"))
