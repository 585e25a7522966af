"""Exact n-gram Jaccard join: size bands, bitmap bounds, then exact sorted-array intersection.

A document's set is its distinct 5-word shingles as 64-bit hashes. Documents
with the same set are one class and go on as their first document. Shingles
are dealt by hash to find out in how many documents each stands (those in very
many documents are known beforehand and not gathered); those that stand in one
document cannot be shared. In the order (documents with the
shingle, shingle), two sets with ``100 * shared >= 80 * union`` share one of
the first few shingles of both (fewer for the smaller set), so documents meet
only on those, and only if their sizes allow the similarity. A pair is then
compared by bitmaps, whose bit counts bound the shared shingles from above,
and where that allows a link, by intersecting the sorted arrays.

Links are wanted as components. So a group is first linked through one of its
members (each member is compared with it), and what is still in different
components is compared again with other members, until a round finds nothing;
only then are all remaining pairs of different components compared, so no link
between components is lost and no group is expanded into all its pairs.

Texts without words have empty sets and no links. Null text is empty. Rows with
one id and different texts, or without id, are separate rows; rows that are
equal are one class. Sizes of tables only set numbers of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe.llm import packing, storage, textops
from caseframe.llm.components import components

SHINGLE = 5
#: Similarity as a fraction: 100 * shared >= 80 * union.
NUMERATOR, DENOMINATOR = 80, 100
#: Shingles per bucket of the dealing, and bits of a bitmap.
BUCKET_ENTRIES = 2_000_000
BITMAP_BITS = 512
#: Members of a component that a document is compared with in a round, and the share of
#: such comparisons that must link for another round; neither changes the result.
PICKS = 4
LEAST_YIELD = 0.1
DEAL_BYTES = 8 << 20
#: A shingle in this share of the documents of a slice is proposed as hot, and is hot if the
#: slices that propose it have it in half that share of all documents: then there are at most
#: the mean set size over that half share of them, and no other shingle is in 1.5 times the share.
HOT_SHARE, HOT_LEAST = 0.01, 8


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending by row, then hash, and their rows."""
    starts, ends, rows = textops.runs(textops.space_table()[raw], offsets)
    words = textops.segment_hash(textops.lower_table()[raw], starts, ends)
    value, first = textops.window_hash(words, rows, SHINGLE)
    count = textops.row_counts(rows, len(offsets) - 1)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):  # the whole sequence, marked by its length
        begin = np.concatenate(([0], np.cumsum(count)))[short]
        whole = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            there = count[short] > k
            whole[there] = whole[there] * textops.ODD + words[begin[there] + k]
        whole = textops.mix(whole ^ (count[short].astype(np.uint64) << np.uint64(56)))
        value, owner = np.concatenate((value, whole)), np.concatenate((rows[first], short))
    else:
        owner = rows[first]
    return textops.unique_per_row(value, owner)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textops.slices(batch, "text"):
            raw, offsets = textops.text_buffer(part.column("text"))
            value, rows = shingle_sets(raw, offsets)
            n = textops.row_counts(rows, part.num_rows)
            keys = [np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.uint64)]
            np.add.at(keys[0], rows, value)
            np.add.at(keys[1], rows, textops.mix(value + textops.MIX2))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n), *(pa.array(k.view(np.int64)) for k in keys)], ["id", "n", "k1", "k2"]
            )


def with_ids(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """(id, doc_id, text) and whether ``id`` is the key itself: it is where the key names all rows apart."""
    named = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    if isinstance(docs.schema[key].dataType, T.IntegralType) and named.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return named.select(F.col("doc_id").cast("long").alias("id"), "doc_id", "text"), True
    return storage.staged(named.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text"), "numbered"), False


def deal_width(entries: int) -> int:
    """Bits of the bucket number for so many entries."""
    return max(3, int(np.ceil(np.log2(max(entries, 1) / BUCKET_ENTRIES + 1))))


def _slice_tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a slice, ascending and whole (64 bits), and the documents that they stand in."""
    values, owners = [], []
    for small in textops.slices(part, "text"):
        value, rows = shingle_sets(*textops.text_buffer(small.column("text")))
        values.append(value)
        owners.append(small.column("id").to_numpy()[rows])
    token, ids = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(token, kind="stable")
    return token[order], ids[order]


def _proposed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textops.slices(batch, "text", DEAL_BYTES):
            kinds, count = np.unique(_slice_tokens(part)[0], return_counts=True)
            hot = count >= max(HOT_SHARE * part.num_rows, least)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[hot].view(np.int64)), pa.array(count[hot])], ["token", "n"])


def hot_tokens(rows: DataFrame, documents: int, least: int = HOT_LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that stand in very many documents, ascending, and about how many; their number is bounded."""
    found = rows.select("text", "id").mapInArrow(lambda b: _proposed(b, least), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    table = found.filter(F.col("n") >= max(HOT_SHARE / 2 * documents, least)).toArrow()
    token, n = table["token"].to_numpy().astype(np.int64).view(np.uint64), table["n"].to_numpy().astype(np.uint64)
    order = np.argsort(token)
    return token[order], n[order]


DEALT = "bucket int, part int, blob binary"


def _deal(batches: Iterator[pa.RecordBatch], bits: int, parts: int, hot: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Tokens and documents by bucket (part -1); those of hot tokens ready for their part, so they never meet in a bucket."""
    shift = np.uint64(64 - bits)
    for batch in batches:
        for slice_ in textops.slices(batch, "text", DEAL_BYTES):
            token, ids = _slice_tokens(slice_)
            known = np.isin(token, hot[0])
            found = _for_parts(token[known], ids[known], hot[1][np.searchsorted(hot[0], token[known])], parts)
            rows = [(p % (1 << bits), p, blob) for p, blob in found]
            token, ids = token[~known], ids[~known]
            rows += [(b, -1, packing.pack(token[at], ids[at])) for b, at in packing.by_bucket((token >> shift).astype(np.int64), 1 << bits)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))] if rows else
                                             [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary())], ["bucket", "part", "blob"])


def _for_parts(token: np.ndarray, ids: np.ndarray, df: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    ids = ids.astype(np.uint64)
    part = _part_of(ids, parts)
    order = np.lexsort((token, ids, part))
    token, ids, df, part = token[order], ids[order], df[order], part[order]
    return [(p, packing.pack(ids[at], token[at], df[at])) for p, at in packing.by_bucket(part, parts)]


def _repeated(table: pa.Table, parts: int) -> pa.Table:
    """Of one bucket: the entries of tokens in two documents or more, dealt by document."""
    rows = list(zip(table.column("part").to_pylist(), table.column("blob").to_pylist()))
    found = [(p, blob) for p, blob in rows if p >= 0]
    pairs = [packing.unpack(blob, 2) for p, blob in rows if p < 0]
    if pairs:
        token, ids = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        order = np.lexsort((ids, token))
        token, ids = token[order], ids[order]
        new = np.concatenate(([True], token[1:] != token[:-1])) if len(token) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        fresh = new.copy()
        fresh[1:] |= ids[1:] != ids[:-1]
        df = np.bincount(group, fresh).astype(np.uint64)[group] if len(token) else np.zeros(0, np.uint64)
        keep = df > 1
        found += _for_parts(token[keep], ids[keep], df[keep], parts)
    return pa.table({"part": pa.array([p for p, _ in found], pa.int32()), "blob": pa.array([x for _, x in found], pa.binary())})


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (textops.mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


CANDIDATES = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("tokens", T.BinaryType()), T.StructField("bitmap", T.ArrayType(T.LongType())),
        T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("index_length", T.IntegerType()),
    ]
)


def _candidates(docs: pa.Table, blobs: pa.Table) -> pa.Table:
    """Of one part: documents whose prefix holds a shingle of other documents, with what a comparison needs."""
    columns: list[list] = [[] for _ in CANDIDATES]
    if docs.num_rows and blobs.num_rows:
        parts = [packing.unpack(b.as_py(), 3) for b in blobs.column("blob")]
        ids, token, df = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.lexsort((token, df, ids))
        ids, token, df = ids[order], token[order], df[order]
        wanted = docs.column("id").to_numpy().astype(np.int64)
        begins, ends = (np.searchsorted(ids, wanted.view(np.uint64), side) for side in ("left", "right"))
        for doc, n, a, b in zip(wanted.tolist(), docs.column("n").to_pylist(), begins.tolist(), ends.tolist()):
            own, alone = token[a:b], n - (b - a)  # shingles of this document only come first
            probe = n - -(-NUMERATOR * n // DENOMINATOR) + 1
            index = n - -(-2 * NUMERATOR * n // (NUMERATOR + DENOMINATOR)) + 1
            if probe <= alone:
                continue
            prefix = list(dict.fromkeys(own[: probe - alone].view(np.int64).tolist()))
            inner = len(dict.fromkeys(own[: max(index - alone, 0)].tolist()))
            bits = np.zeros(BITMAP_BITS, np.uint8)
            bits[(own % np.uint64(BITMAP_BITS)).astype(np.int64)] = 1
            row = (doc, n, np.sort(own).tobytes(), np.packbits(bits).view(np.int64).tolist(), prefix, inner)
            for column, value in zip(columns, row):
                column.append(value)
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], CANDIDATES.names)


def allowed(small: Column, large: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return DENOMINATOR * small >= NUMERATOR * large


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of (n, bitmap, tokens) that link: bitmaps bound the shared shingles, arrays count them."""
    for batch in batches:
        at = {name: batch.column(name) for name in batch.schema.names}
        na, nb = at["a_n"].to_numpy(), at["b_n"].to_numpy()
        need = -(-NUMERATOR * (na + nb) // (NUMERATOR + DENOMINATOR))
        words = [at[c].flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1) for c in ("a_bitmap", "b_bitmap")]
        a_len = np.array([len(x.as_buffer()) // 8 for x in at["a_tokens"]])
        b_len = np.array([len(x.as_buffer()) // 8 for x in at["b_tokens"]])
        # a token set in one bitmap alone cannot be shared
        most = np.minimum(a_len - np.bitwise_count(words[0] & ~words[1]).sum(1), b_len - np.bitwise_count(words[1] & ~words[0]).sum(1))
        keep = []
        for i in np.flatnonzero(most >= need):
            a, b = (np.frombuffer(at[c][i].as_buffer(), np.uint64) for c in ("a_tokens", "b_tokens"))
            if len(np.intersect1d(a, b)) >= need[i]:
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def bounded(a: str, b: str) -> Column:
    """Whether the bitmaps of two sets let them share enough: a shingle marked in one bitmap alone is not shared."""
    alone = lambda x, y: sum((F.bit_count(F.col(f"{x}_{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{k}")))) for k in range(BITMAP_BITS // 64)), F.lit(0))
    most = F.least(F.col(f"{a}_r") - alone(a, b), F.col(f"{b}_r") - alone(b, a))
    return (NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (F.col(f"{a}_n") + F.col(f"{b}_n"))


def linked(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    side = lambda s: candidates.select(F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("n", "bitmap", "tokens")))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.mapInArrow(_compare, "a long, b long")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links: components of the labels that the links connect."""
    of = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    merged = components(between).select(F.col("id").alias("label"), F.col("label").alias("least"))
    return labels.join(merged, "label", "left").select("id", F.coalesce("least", "label").alias("label"))


def links_between(candidates: DataFrame) -> DataFrame:
    """(id, label): each candidate and the least candidate that links connect it with."""
    postings = candidates.select("id", "n", "index_length", F.posexplode("prefix").alias("at", "token"))
    first = postings.groupBy("token").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("members"))
    met = postings.join(first.filter("members > 1"), "token").filter("id <> lead.id")
    fits = allowed(F.least("n", F.col("lead.n")), F.greatest("n", F.col("lead.n")))
    pairs = met.filter(fits).select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct()
    alone = candidates.select("id", F.col("id").alias("label"))
    labels = storage.staged(_relabelled(alone, linked(pairs, candidates)), "labels")
    seed = 0
    while True:  # other members of the largest component that a document meets
        placed = postings.join(labels, "id")
        draw = F.xxhash64("id", F.pmod("token", F.lit(PICKS)), F.lit(seed))
        counts = placed.groupBy("token", "label").agg(F.count("*").alias("members"), F.min(F.struct(draw.alias("h"), "id", "n")).alias("pick"))
        main = counts.groupBy("token").agg(F.max(F.struct("members", "label", "pick")).alias("main"), F.count("*").alias("labels")).filter("labels > 1")
        other = placed.join(main, "token").filter("label <> main.label").withColumn("lead", F.col("main.pick"))
        pairs = storage.staged(other.filter(fits).select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct(), "pairs")
        new = storage.staged(linked(pairs, candidates), "links")
        found = new.count()
        if found:
            labels = storage.staged(_relabelled(labels, new), "labels")
        if found < LEAST_YIELD * pairs.count() or not found:  # too few to go on: all pairs that are left are compared below
            break
        seed += 1
    # what is left: pairs of different components, by size band of the join and bitmap bound
    placed = storage.staged(postings.join(labels, "id"), "postings")
    open_tokens = placed.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("token")
    marks = candidates.select(
        "id", (F.octet_length("tokens") / 8).cast("long").alias("r"), *(F.get("bitmap", F.lit(k)).alias(str(k)) for k in range(BITMAP_BITS // 64))
    )
    left = placed.join(open_tokens, "token", "left_semi").join(marks, "id")
    side = lambda s, rows: rows.select("token", *(F.col(c).alias(s if c == "id" else f"{s}_{c}") for c in ("n", "label", *marks.columns)))
    apart = (F.col("a_label") != F.col("b_label")) & (F.col("a_n") <= F.col("b_n")) & allowed(F.col("a_n"), F.col("b_n")) & bounded("a", "b")
    small = side("a", left.filter("at < index_length")).withColumnRenamed("token", "of")
    rest = small.join(side("b", left), (F.col("of") == F.col("token")) & apart)
    pairs = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _relabelled(labels, linked(pairs, candidates))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_least: int = HOT_LEAST) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (the smallest key reachable by links)."""
    rows, named_by_key = with_ids(docs, key, text)
    sets = storage.staged(rows.select("id", "text").mapInArrow(_sets, "id long, n long, k1 long, k2 long"), "sets")
    full = sets.filter("n > 0")
    total, documents = full.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bits = deal_width(total)
    parts = max(1, (1 << bits) // 4)
    classes = full.groupBy("k1", "k2", "n").agg(F.min("id").alias("first"))

    hot = hot_tokens(rows, documents, hot_least)
    dealt = rows.select("id", "text").mapInArrow(lambda b: _deal(b, bits, parts, hot), DEALT)
    shared = dealt.groupBy("bucket").applyInArrow(lambda t: _repeated(t, parts), "part int, blob binary")
    firsts = classes.select(F.col("first").alias("id"), "n").mapInArrow(lambda b: _with_part(b, parts), "part int, id long, n long")
    candidates = storage.staged(firsts.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(_candidates, CANDIDATES), "candidates")
    labels = links_between(candidates)

    of_class = classes.join(labels.withColumnRenamed("id", "first"), "first", "left").select(
        "k1", "k2", F.col("n").alias("n_of"), F.coalesce("label", "first").alias("label")
    )
    same = (sets["k1"] == of_class["k1"]) & (sets["k2"] == of_class["k2"]) & (sets["n"] == of_class["n_of"]) & (sets["n"] > 0)
    placed = sets.join(of_class, same, "left").select("id", "n", F.coalesce("label", "id").alias("label"))
    if named_by_key:
        return placed.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))
    named = placed.join(rows.select("id", "doc_id"), "id")
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "label").select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _with_part(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part = _part_of(batch.column("id").to_numpy().view(np.uint64), parts)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch.column("id"), batch.column("n")], ["part", "id", "n"])


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest key stays.

    Where the key does not name rows apart, rows are numbered and the first number stays.
    """
    if with_ids(docs, key, text)[1]:
        gone = near_duplicates(docs, key, text).filter(F.col(key) != F.col("component_id")).select(key)
        return docs.join(storage.staged(gone, "near-duplicates"), key, "left_anti").select(*docs.columns)
    numbered = storage.staged(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    gone = near_duplicates(numbered, "__row", text).filter(F.col("__row") != F.col("component_id")).select("__row")
    return numbered.join(storage.staged(gone, "near-duplicates"), "__row", "left_anti").drop("__row")
