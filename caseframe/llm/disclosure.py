"""Personal data: patterns, and terms that reveal a protected entity by corpus co-occurrence.

Patterns find the protected entities. A document tells of an entity by all its
terms; equal texts (copies) count once. With N documents, n(e) of them with an
entity, n(t) with a term and n(t, e) with both, the entity's information is
IC(e) = -log2(n(e) / N) and the term tells PMI(t; e) = log2(N * P / n(e)) bits
of it, where P = n(t, e) / (n(t) + ``SMOOTHING``) is the smoothed share of the
term's documents that hold the entity. A term that tells ``DISCLOSURE`` or more
of IC(e) reveals the entity: its occurrences in documents with that entity
become spans of kind ``term``, also if the entity stands in one document. On
sanitising, terms that tell ``REMOVAL`` of it are removed, other terms are
generalised to their kind of word, entities to their kind.

Terms are maximal runs of ASCII letters, digits and other characters outside
ASCII, A-Z lower-cased, of three characters or more with a letter. A null text
is empty. Offsets are code points, the end exclusive. Rows are told apart by
position, not by key, where keys repeat or are missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe.llm import contamination, storage, textops
from caseframe.llm import spans as S
from caseframe.llm.jaccard import with_ids

#: Documents with a term but without the entity that are taken to exist unseen.
SMOOTHING = 2
#: Terms with at least this share of the pairs of document and term may be left out early, if too common to reveal.
HOT_SHARE = 1 / 5000
#: Bits of the filter that tells which rows may be copies, so that only their texts are shuffled.
FILTER_BITS = 1 << 22
DISCLOSURE = 0.75
REMOVAL = 0.95
#: Fixed kinds in their order, and the fixed pattern of each. The e-mail's part before
#: the @ is read backwards from it, so that long runs without one cost no rescans.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ORDER = {k: i for i, k in enumerate((*KINDS, "term"))}
MAYBE = r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]([ -]?[0-9]){15}|\+[0-9]"
TERM = re.compile(contamination.WORD)
TO_LOWER = str.maketrans(contamination.UPPER, contamination.LOWER)
LETTER = re.compile(r"[^\W\d_]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[S.Span]:
    """Protected entities by kind, then start."""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    found = [(a, b, "email") for a, b in _emails(text)]
    found += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if 16 <= len(d := digits(m[0])) <= 19 and _luhn(d):
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return found


def entity(text: str, span: S.Span) -> str:
    """One name for all ways to write an entity."""
    value = text[span[0] : span[1]]
    return f"{span[2]}:{value.lower() if span[2] == 'email' else value if span[2] == 'ip' else re.sub(r'[^0-9]', '', value)}"


def terms(text: str) -> list[tuple[int, int, str]]:
    lower = text.translate(TO_LOWER)
    return [(m.start(), m.end(), m[0]) for m in TERM.finditer(lower) if m.end() - m.start() >= 3 and LETTER.search(m[0])]


def term_table() -> np.ndarray:
    """True for a byte of a term."""
    table = np.zeros(256, bool)
    table[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
    return table


def term_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of term bytes."""
    lower = textops.lower_table()[raw]
    starts, ends, rows = textops.runs(term_table()[lower], offsets)
    return textops.segment_hash(lower, starts, ends).view(np.int64), rows


def hashed(found: list[tuple[int, int, str]]) -> list[int]:
    raw = np.frombuffer("\n".join(t for _, _, t in found).encode(), np.uint8)
    return term_hashes(raw, np.array([0, len(raw)]))[0].tolist()


def outside(text: str, spans: list[S.Span]) -> list[tuple[int, int, str]]:
    """The terms that lie in no entity."""
    covered = S.merged(spans)
    out, k = [], 0
    for a, b, t in terms(text):
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if k == len(covered) or covered[k][0] >= b:
            out.append((a, b, t))
    return out


def _found(batch: pa.RecordBatch):
    column = batch.column("text")
    spans, names, near, held = [], [], [], []
    for i, possible in enumerate(S.maybe(column, MAYBE)):
        text = column[i].as_py() if possible else ""
        own = base_spans(text)
        spans.append([{"kind": k, "start": a, "end": b} for a, b, k in own])
        names.append(sorted({entity(text, s) for s in own}))
        near.append(sorted(set(hashed(outside(text, own)))) if own else [])
        held.append(text if own else None)
    return [spans, names, near, held]


def entities(rows: DataFrame) -> DataFrame:
    """(id, doc_id, copy, spans, entities, terms, held) of each row of (id, doc_id, text).

    ``copy`` is equal for equal texts, ``terms`` hashes the terms outside the
    entities, ``held`` is the text; both only where there is an entity.
    """
    fields = [
        T.StructField("spans", S.SPANS), T.StructField("entities", T.ArrayType(T.StringType())),
        T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("held", T.StringType()),
    ]
    named = rows.select("id", "doc_id", "text", F.md5(F.col("text").cast("binary")).alias("copy"))
    return S.with_columns(named, fields, _found, keep=("id", "doc_id", "copy"))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents of a slice with each term."""
    for batch in batches:
        for part in textops.slices(batch, "text"):
            value, rows = term_hashes(*textops.text_buffer(part.column("text")))
            kinds, n = np.unique(textops.unique_per_row(value, rows)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], ["term", "n"])


def _filtered(batches: Iterator[pa.RecordBatch], bits: np.ndarray, wanted: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose bit is set, or whose bit is not."""
    for batch in batches:
        at = batch.column("bit").to_numpy()
        yield batch.filter(pa.array(((bits[at >> 3] >> (at & 7)) & 1).astype(bool) == wanted))


def term_documents(found: DataFrame, firsts: DataFrame, rows: DataFrame) -> DataFrame:
    """(term, n_t): distinct texts with each term."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).cast("int").alias("bit")
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    later = found.select("id").join(firsts, "id", "left_anti").select(bit).distinct().toArrow()["bit"].to_numpy()  # FILTER_BITS at most
    np.bitwise_or.at(bits, later >> 3, (1 << (later & 7)).astype(np.uint8))
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    placed = rows.select("id", "text", bit)
    surely = placed.mapInArrow(lambda b: _term_counts(_filtered(b, shared.value, False)), "term long, n long")
    maybe = placed.mapInArrow(lambda b: _filtered(b, shared.value, True), placed.schema).join(firsts, "id", "left_semi")
    both = surely.unionByName(maybe.select("text").mapInArrow(_term_counts, "term long, n long"))
    return both.groupBy("term").agg(F.sum("n").alias("n_t"))


def revealing_terms(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, term, told): hashes of the terms of each row that reveal one of its entities, and the most information told."""
    firsts = storage.staged(found.groupBy("copy").agg(F.min("id").alias("id")).select("id"), "first-copies")
    total = float(max(firsts.count(), 1))
    own = found.filter(F.size("entities") > 0).select("id", "entities", "terms").join(firsts.withColumn("first", F.lit(True)), "id", "left")
    own = storage.staged(own, "rows-with-entities")
    named = own.select("id", "first", F.explode("entities").alias("entity"))
    of_entity = named.filter("first").groupBy("entity").agg(
        F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("id")).alias("a"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("b")
    )
    # Entities of the same documents have the same figures: they are one group.
    of_entity = of_entity.select("entity", "n_e", F.xxhash64("n_e", "a", "b").alias("group"))
    groups = storage.staged(named.join(of_entity, "entity").select("id", "first", "group", "n_e").distinct(), "entity-groups")
    most = groups.agg(F.coalesce(F.max("n_e"), F.lit(0))).first()[0]
    # told >= DISCLOSURE only where n_t + SMOOTHING <= n_e ** DISCLOSURE * N ** (1 - DISCLOSURE).
    common = most**DISCLOSURE * total ** (1 - DISCLOSURE) * (1 + 1e-9)
    of_term = term_documents(found, firsts, rows).filter(F.col("n_t") + SMOOTHING <= common)

    each = own.select("id", "first", F.explode("terms").alias("term"))
    size = own.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    hot = each.filter("first").groupBy("term").count().filter(F.col("count") > max(common, size * HOT_SHARE)).select("term")
    rare = each.select("id", "term").join(F.broadcast(hot), "term", "left_anti")  # 1 / HOT_SHARE terms at most
    pairs = storage.staged(groups.join(rare.join(storage.staged(of_term, "term-counts"), "term"), "id"), "term-pairs")
    told = pairs.groupBy("group", "term", "n_e", "n_t").agg(F.count(F.when(F.col("first"), 1)).alias("n_te")).withColumn("told", _told(total))
    told = told.filter(F.col("told") >= DISCLOSURE).select("group", "term", "told")
    return pairs.select("id", "group", "term").join(told, ["group", "term"]).groupBy("id", "term").agg(F.max("told").alias("told"))


def _told(total: float) -> Column:
    """Share of the entity's information that the term tells."""
    information = F.log2(F.lit(total) / F.col("n_e"))
    pointwise = F.log2(F.col("n_te") * total / ((F.greatest("n_t", "n_te") + SMOOTHING) * F.col("n_e")))
    return F.when(information > 0, pointwise / information).otherwise(0.0)


def _term_spans(batch: pa.RecordBatch):
    out = []
    for text, own, told in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "told"))):
        levels = {x["term"]: x["told"] for x in told}
        around = outside(text, [(s["start"], s["end"], s["kind"]) for s in own])
        out.append([{"kind": "term", "start": a, "end": b, "told": levels[h]} for (a, b, _), h in zip(around, hashed(around)) if h in levels])
    return [out]


TERM_SPANS = T.ArrayType(T.StructType([*S.SPANS.elementType.fields, T.StructField("told", T.DoubleType())]))


def _analysed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The numbered rows (id, doc_id, text), and (id, doc_id, spans, term_spans) of each."""
    rows, _ = with_ids(docs, key, text)
    found = storage.staged(entities(rows), "entities")
    told = revealing_terms(found, rows).groupBy("id").agg(F.collect_list(F.struct("term", "told")).alias("told"))
    held = found.filter(F.size("entities") > 0).select("id", F.col("held").alias("text"), "spans")
    marked = S.with_columns(held.join(told, "id"), [T.StructField("term_spans", TERM_SPANS)], _term_spans, keep=("id",))
    out = found.select("id", "doc_id", "spans").join(storage.staged(marked, "term-spans"), "id", "left")
    return rows, out.withColumn("term_spans", F.coalesce("term_spans", F.array().cast(TERM_SPANS)))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: base counts by kind, the digest of the base spans, all spans as text, and the number of terms."""
    _, found = _analysed(docs, key, text)
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    terms_line = line(F.col("term_spans"))
    return found.select(
        F.col("doc_id").alias(key), *(number(k) for k in KINDS), F.sha2(line(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.filter(F.array(line(F.col("spans")), terms_line), lambda x: x != ""), ",").alias("spans"),
        F.size("term_spans").cast("long").alias("n_terms"),
    )


def general(word: str) -> str:
    """What a term is generalised to: a name if it is written with a capital, a number with letters, or a word."""
    return "[name]" if word[0].isupper() else "[code]" if any(c.isdigit() for c in word) else "[word]"


def _sanitised(batch: pa.RecordBatch):
    out = []
    for text, own, told in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "term_spans"))):
        if text is None or not (own or told):
            out.append(text)
            continue
        swaps = [(a, b, f"[{k}]") for a, b, k in S.merged([(s["start"], s["end"], s["kind"]) for s in own])]
        swaps += [(s["start"], s["end"], "" if s["told"] >= REMOVAL else general(text[s["start"] : s["end"]])) for s in told]
        parts, last = [], 0
        for a, b, new in sorted(swaps):
            parts += [text[last:a], new]
            last = b
        out.append("".join(parts) + text[last:])
    return [out]


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with entities replaced by their kinds and revealing terms generalised or removed."""
    rows, found = _analysed(docs, key, text)
    both = rows.select("id", "text").join(found, "id")
    out = S.with_columns(both.withColumnRenamed("text", "old").withColumn("text", F.col("old")), [T.StructField("clean", T.StringType())], _sanitised, keep=("doc_id",))
    return out.select(F.col("doc_id").alias(key), F.col("clean").alias(text))
