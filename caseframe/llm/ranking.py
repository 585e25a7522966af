"""Ranked lexical search by pair-bound MaxScore.

Documents are indexed in shards of about ``SHARD_BYTES`` of text: postings of
the terms that the queries ask for. When the collection's counts are known, a
second pass turns frequencies into score contributions, keeps the largest of
every list, and intersects the lists of the shard's ``FREQUENT`` most common
terms pairwise, keeping each intersection's largest joint contribution.

A task then answers all items on its shards, one shard after the other, and
keeps the best ``k`` documents of each item so far; their least score is the
item's threshold. Terms are taken from the least bound upwards while what they
can add together stays below the threshold; such a set of terms is bounded by
matching it into pairs, as two terms seldom peak in one document. Documents
with none of the other, essential terms cannot enter. The essential lists are
added up, and the candidates look up the rest, largest bounds first, and are
given up as soon as their score and the pair bound of what is left fall below
the threshold. Scores are exact; nothing is sampled.

Items are taken in blocks of about ``ITEM_BYTES`` of text, which bounds what the
driver sends to the tasks; every block reads the documents once. A null text has
no terms. An item without terms, or whose terms no document has, has no result;
repeated item rows have repeated results; documents that share a ``doc_id`` are
ranked one by one, and a null key comes last among equal scores. Texts are taken
whole, empty tables give an empty table, other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe.llm import storage, textops

SHARD_BYTES = 8 << 20
ITEM_BYTES = 4 << 20
FREQUENT = 48
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@lru_cache
def term_table() -> np.ndarray:
    """True for a byte of a term: digits, letters and everything beyond ASCII."""
    table = np.ones(256, bool)
    table[:128] = False
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z")):
        table[ord(a) : ord(b) + 1] = True
    return table


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, and start, end and row of every term."""
    raw, at = textops.text_buffer(texts)
    raw = textops.lower_table()[raw]
    return raw, *textops.runs(term_table()[raw], at)


@dataclass
class Vocabulary:
    """Terms as bytes, numbered by their hashes."""

    terms: list[bytes]

    def __post_init__(self) -> None:
        raw = np.frombuffer(b"".join(self.terms), np.uint8)
        ends = np.cumsum([len(t) for t in self.terms]).astype(np.int64)
        hashes = textops.segment_hash(raw, ends - [len(t) for t in self.terms], ends)
        order = np.argsort(hashes, kind="stable")
        self.terms = [self.terms[i] for i in order]
        self.hashes = hashes[order]
        self.lengths = np.array([len(t) for t in self.terms], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.raw = np.frombuffer(b"".join(self.terms), np.uint8)
        self.numbers = {t: i for i, t in enumerate(self.terms)}
        self.widest = int(np.unique(self.hashes, return_counts=True)[1].max()) if self.terms else 0

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each term, -1 for a term that is not listed; hashes propose, bytes decide."""
        found = np.full(len(starts), -1, np.int64)
        if not self.terms or not len(starts):
            return found
        hashes, lengths = textops.segment_hash(raw, starts, ends), ends - starts
        first = np.searchsorted(self.hashes, hashes)
        for step in range(self.widest):  # 1 unless two listed terms have one hash
            place = np.minimum(first + step, len(self.hashes) - 1)
            maybe = np.flatnonzero((self.hashes[place] == hashes) & (self.lengths[place] == lengths) & (found < 0))
            size = lengths[maybe]
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            equal = raw[inner + np.repeat(starts[maybe], size)] == self.raw[inner + np.repeat(self.starts[place[maybe]], size)]
            same = np.add.reduceat(equal, np.cumsum(size) - size) == size if len(maybe) else np.zeros(0, bool)
            found[maybe[same]] = place[maybe[same]]
        return found


def _press(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def _expand(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _row(schema: T.StructType, values: list, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], schema.names)


def postings(docs: DataFrame, key: str, text: str, vocabulary: Vocabulary, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(ids, lengths, terms, docs, tf, n_docs, n_terms): one row a shard; the lists are sorted by term and document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of a block of items
    long, blob = T.LongType(), T.BinaryType()
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(docs.schema[key].dataType)), *[T.StructField(n, blob) for n in ("lengths", "terms", "docs", "tf")],
        T.StructField("n_docs", long), T.StructField("n_terms", long),
    ])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        ids, lengths, found, size = [], [], [], 0

        def row():
            n = np.concatenate(lengths)
            pairs = np.concatenate([f[0] for f in found])
            order = np.argsort(pairs, kind="stable")
            tf = np.concatenate([f[1] for f in found])[order].astype(np.int32)
            pairs = pairs[order]
            held = pa.concat_arrays(ids)
            columns = [pa.array([_press(a)], pa.binary()) for a in (n, (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), tf)]
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), *columns, pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])],
                schema.names,
            )

        for batch in batches:
            for piece in textops.slices(batch, text):
                raw, starts, ends, rows = _terms(piece.column(text))
                numbers = words.find(raw, starts, ends)
                known = numbers >= 0
                at = rows[known] + sum(map(len, lengths))
                found.append(np.unique((numbers[known] << 32) | at, return_counts=True))
                ids.append(piece.column(key))
                lengths.append(textops.row_counts(rows, piece.num_rows))
                size += len(raw)
                if size >= shard_bytes:
                    yield row()
                    ids, lengths, found, size = [], [], [], 0
        if ids:
            yield row()

    return docs.select(key, text).mapInArrow(index, schema)


def document_counts(shards: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each listed term stands; every task counts its shards before it sends anything."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for blob in batch.column("terms").to_pylist():
                total += np.bincount(_expand(blob, np.int32), minlength=n_terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["term", "df"])

    rows = shards.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(n_terms, np.int64)
    for term, df in rows:
        out[term] = df
    return out


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def bounded(shards: DataFrame, weight: np.ndarray, n: int, total: int) -> DataFrame:
    """(ids, held, ends, docs, gains, tops, common, joint): contributions, their maxima, and those of term pairs.

    ``joint`` holds for every two of the shard's ``common`` terms the largest sum of
    their contributions to one document with both, 0 if there is none.
    """
    shared = shards.sparkSession.sparkContext.broadcast(weight)
    blobs = ("held", "ends", "docs", "gains", "tops", "common", "joint")
    schema = T.StructType([shards.schema["ids"], *[T.StructField(b, T.BinaryType()) for b in blobs]])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lengths, terms, docs, tf = (_expand(batch.column(c)[k].as_py(), t) for c, t in (("lengths", np.int64), ("terms", np.int32), ("docs", np.int32), ("tf", np.int32)))
                m = 75 + (25 * lengths * n) // max(total, 1)
                tf = tf.astype(np.int64)
                gains = shared.value[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs]))
                held, first, size = np.unique(terms, return_index=True, return_counts=True)
                tops = np.maximum.reduceat(gains, first) if len(held) else np.zeros(0, np.int64)
                common = np.sort(np.argsort(-size, kind="stable")[:FREQUENT])
                table = np.zeros((len(common), len(lengths)), np.int64)
                for row, c in enumerate(common.tolist()):
                    table[row, docs[first[c] : first[c] + size[c]]] = gains[first[c] : first[c] + size[c]]
                joint = np.zeros((len(common), len(common)), np.int64)
                for row in range(len(common)):
                    both = (table[row] > 0) & (table[row + 1 :] > 0)
                    joint[row, row + 1 :] = np.where(both, table[row] + table[row + 1 :], 0).max(1, initial=0)
                joint += joint.T
                out = [_press(a) for a in (held.astype(np.int64), first + size, docs, gains, tops, common, joint)]
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(k, 1), *(pa.array([b], pa.binary()) for b in out)], schema.names)

    return shards.select("ids", "lengths", "terms", "docs", "tf").mapInArrow(bound, schema)


class Shard:
    """One shard's lists and bounds, ready to answer items."""

    def __init__(self, blobs: dict[str, bytes], n_docs: int):
        ints = {"docs": np.int32}
        held, ends, self.docs, self.gains, tops, common, joint = (
            _expand(blobs[c], ints.get(c, np.int64)) for c in ("held", "ends", "docs", "gains", "tops", "common", "joint")
        )
        self.place = {int(t): i for i, t in enumerate(held)}
        self.ends, self.tops = ends.tolist(), tops.tolist()
        self.pair = {int(c): i for i, c in enumerate(common)}
        self.joint = joint.reshape(len(common), len(common)).tolist()
        self.score = np.zeros(n_docs, np.int64)

    def list_of(self, p: int) -> slice:
        return slice(self.ends[p - 1] if p else 0, self.ends[p])

    def prefix_bounds(self, terms: list[tuple[int, int, int]], enough: int) -> list[int]:
        """``terms`` (bound, place, times) ascend by bound: what the first 0, 1, 2, ... can add to one document.

        A set's bound is that of a matching into pairs; the list ends with the first bound of ``enough``.
        """
        bounds, free = [0], []
        for top, p, times in terms:
            row, saved = self.pair.get(p), 0
            if row is not None:
                best = None
                for i, (other_top, other_row, other_times) in enumerate(free):
                    together = max(min(self.joint[row][other_row] * max(times, other_times), top + other_top), top, other_top)
                    if top + other_top - together > saved:
                        best, saved = i, top + other_top - together
                if best is None:
                    free.append((top, row, times))
                else:
                    free.pop(best)
            bounds.append(bounds[-1] + top - saved)
            if bounds[-1] >= enough:
                break
        return bounds

    def best(self, item: list[tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of an item (term, times), all with a score of ``least`` or more, and no other."""
        terms = sorted((self.tops[p] * times, p, times) for t, times in item if (p := self.place.get(t)) is not None)
        bounds = self.prefix_bounds(terms, least)
        if bounds[-1] < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        split = len(bounds) - 2  # the first so many terms are not essential
        score = self.score
        for _, p, times in terms[split:]:
            at = self.list_of(p)
            score[self.docs[at]] += self.gains[at] * times
        found = np.flatnonzero(score)
        value = score[found]
        score[found] = 0
        for k in range(split - 1, -1, -1):
            on = value + bounds[k + 1] >= least
            found, value = found[on], value[on]
            if not len(found):
                break
            _, p, times = terms[k]
            at = self.list_of(p)
            docs = self.docs[at]
            where = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            value = value + np.where(docs[where] == found, self.gains[at][where] * times, 0)
        on = value >= least
        return found[on], value[on]


def _in_rank(row: tuple) -> tuple:
    score, key = row
    return -score, key is None, key if key is not None else 0


def best_of_tasks(shards: DataFrame, items: list[list[tuple[int, int]]], k: int) -> DataFrame:
    """(item, key, score): of each task, the best ``k`` documents of each item."""
    shared = shards.sparkSession.sparkContext.broadcast(items)  # a block of items
    schema = T.StructType([
        T.StructField("item", T.IntegerType()), T.StructField("key", shards.schema["ids"].dataType.elementType), T.StructField("score", T.LongType()),
    ])
    names = [c for c in shards.columns if c != "ids"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[list[tuple]] = [[] for _ in shared.value]
        key_type = None
        for batch in batches:
            for n in range(batch.num_rows):
                ids = batch.column("ids")[n].values
                key_type = ids.type
                shard = Shard({c: batch.column(c)[n].as_py() for c in names}, len(ids))
                for number, item in enumerate(shared.value):
                    held = tops[number]
                    docs, scores = shard.best(item, held[-1][0] if len(held) == k else 1)
                    if len(docs) > k:  # documents below the k-th score of this shard alone cannot stay
                        on = scores >= np.partition(scores, -k)[-k]
                        docs, scores = docs[on], scores[on]
                    if len(docs):
                        new = zip(scores.tolist(), ids.take(pa.array(docs)).to_pylist())
                        tops[number] = sorted([*held, *new], key=_in_rank)[:k]
        rows = [(i, key, score) for i, held in enumerate(tops) for score, key in held]
        if rows:
            columns = zip(*rows)
            types = (pa.int32(), key_type, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

    return shards.mapInArrow(search, schema)


def _item_terms(texts: list[str | None]) -> list[Counter]:
    raw, starts, ends, rows = _terms(pa.array(texts, pa.string()))
    whole, out = raw.tobytes(), [Counter() for _ in texts]
    for a, b, row in zip(starts.tolist(), ends.tolist(), rows.tolist()):
        out[row][whole[a:b]] += 1
    return out


def _ranked_block(docs: DataFrame, items: DataFrame, key: str, text: str, k: int, shard_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    rows = items.collect()  # about ITEM_BYTES
    counted = _item_terms([r["text"] for r in rows])
    vocabulary = Vocabulary(sorted(set().union(*counted)))
    shards = storage.staged(postings(docs, key, text, vocabulary, shard_bytes), "postings")
    n, total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    weight = weights(document_counts(shards, len(vocabulary.terms)), n or 0)
    index = storage.staged(bounded(shards, weight, n or 0, total or 0), "bounds")
    asked = [[(vocabulary.numbers[t], times) for t, times in c.items()] for c in counted]
    best = best_of_tasks(index, asked, k)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last()))
    ranked = best.withColumn("rank", place).filter(F.col("rank") <= k)
    names = spark.createDataFrame(
        [(i, r["item_id"]) for i, r in enumerate(rows)],
        T.StructType([T.StructField("number", T.IntegerType()), T.StructField("item_id", items.schema["item_id"].dataType)]),
    )
    return ranked.join(F.broadcast(names), F.col("item") == F.col("number")).select("item_id", "rank", F.col("key").alias(key), "score")


def ranked(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    k: int = 20, shard_bytes: int = SHARD_BYTES, item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(item_id, rank, key, score): the ``k`` best documents of every item with a score above 0."""
    asked = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // item_bytes) or 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [_ranked_block(docs, asked.filter(block == b), key, text, k, shard_bytes) for b in range(blocks)]).withColumnRenamed("item_id", item_key)


ORACLE_SQL = rf"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents WHERE text IS NOT NULL
), sizes AS (SELECT doc_id, len(w) AS n FROM doc WHERE len(w) > 0
), total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), item AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark WHERE text IS NOT NULL
    ) GROUP BY ALL
), tf AS (
    SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM doc) WHERE term IN (SELECT term FROM item) GROUP BY ALL
), weight AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, docs
), gain AS (
    SELECT tf.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS gain
    FROM tf JOIN weight USING (term) JOIN sizes USING (doc_id), total
), scored AS (SELECT item_id, doc_id, sum(times * gain)::BIGINT AS score FROM item JOIN gain USING (term) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
) WHERE rank <= 20
"""
