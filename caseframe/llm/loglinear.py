"""Language-model scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

Token counts over all training documents come first. The ``CLASSES`` most
frequent tokens, by their exact counts, become classes of the model; all others are one class, the end another. Tokens are
dealt by hash: a slice of documents sends one sum for each class token, so no
hot token gathers its documents, and for other tokens the documents with them;
a bucket counts its tokens and returns sums for each document. The model predicts a class from the two
tokens before: their vectors, weighted by place, against the vector of each
class. Every partition trains on all its training tokens from the same start
by noise-contrastive estimation, and the parameters are averaged by tokens.
Scoring takes the softmax over all classes for the distinct contexts of a slice
in one matrix product, so the probabilities are normalised; a rare token has
the probability of its class times (c + 1) / (n + v + 1) among the n rare
tokens of v kinds.

A null or empty text is its end alone. A row without ``doc_id`` is scored, not
learned from; rows that share one are scored one by one. Nothing is cut: very long
texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.llm import packing, storage, textops
from caseframe.llm.jaccard import DEAL_BYTES, deal_width, with_ids

CLASSES = 256
DIMENSIONS = 16
CONTEXT = 2
NOISE = 32
#: Tokens that a partition counts before it passes the counts on: bounds memory, not results.
HELD_KINDS = 1 << 20
BATCH = 4096
RATE = 0.05
#: Sums of logarithms are integers of this unit, so that they do not depend on the order of adding.
UNIT = 2.0**-32
END = np.uint64(0x5EED)
FOLDS, HELD_FOLD = 7, 2


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(True))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row, an end after each row, and their rows."""
    starts, ends, rows = textops.runs(textops.space_table()[raw], offsets)
    n = len(offsets) - 1
    value = np.full(len(rows) + n, END, np.uint64)
    value[np.arange(len(rows)) + rows] = textops.segment_hash(textops.lower_table()[raw], starts, ends)
    return value, np.repeat(np.arange(n), np.bincount(rows, minlength=n) + 1)


def fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x / UNIT).astype(np.int64)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a partition and their counts; what is held is passed on when it is many, and Spark adds it up."""
    held, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        kinds, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return kinds, np.bincount(at, np.concatenate([c for _, c in held]), minlength=len(kinds)).astype(np.int64)

    def row(kinds: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(counts)], ["a", "b"])

    for batch in batches:
        for part in textops.slices(batch, "text"):
            value, _ = tokens(*textops.text_buffer(part.column("text")))
            held.append(np.unique(value[value != END], return_counts=True))
            size += len(held[-1][0])
            if size > HELD_KINDS:
                held = [merged()]
                if len(held[0][0]) > HELD_KINDS // 2:
                    yield row(*held[0])
                    held = []
                size = sum(len(k) for k, _ in held)
    if held:
        yield row(*merged())


def class_tokens(training: DataFrame) -> np.ndarray:
    """Hashes, ascending, of the ``CLASSES`` most frequent tokens (equal counts: the lesser as a signed number), by exact counts."""
    each = training.select("text").mapInArrow(_common, "a long, b long")
    top = each.groupBy("a").agg(F.sum("b").alias("b")).orderBy(F.desc("b"), "a").limit(CLASSES).collect()
    return np.sort(np.array([r.a for r in top], np.int64).view(np.uint64))


def _deal(batches: Iterator[pa.RecordBatch], bits: int, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(bucket, blob): the tokens of a slice with document, occurrences and how they count.

    Counting: 0 held out, 1 training, 2 a sum over the slice's training documents.
    """
    summed = np.append(classes, END)
    for batch in batches:
        for part in textops.slices(batch, "text", DEAL_BYTES):
            values, owners, before = [], [], 0
            for small in textops.slices(part, "text"):
                value, rows = tokens(*textops.text_buffer(small.column("text")))
                values.append(value)
                owners.append(rows + before)
                before += small.num_rows
            value, row = np.concatenate(values), np.concatenate(owners)
            trains = ~np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), bool)
            common = np.isin(value, summed)
            sums, sum_of = np.unique(value[common & trains[row]], return_counts=True)
            value, row = value[~common], row[~common]
            order = np.lexsort((row, value))
            value, row = value[order], row[order]
            new = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])))) if len(value) else np.zeros(0, np.int64)
            times = np.concatenate((np.diff(np.append(new, len(value))), sum_of))
            how = np.concatenate((trains[row[new]].astype(np.int64), np.full(len(sums), 2)))
            ids = np.concatenate((part.column("id").to_numpy()[row[new]], np.zeros(len(sums), np.int64)))
            value = np.concatenate((value[new], sums))
            order = np.argsort(value, kind="stable")
            value, ids, times, how = value[order], ids[order], times[order], how[order]
            found = [
                (b, packing.pack(value[at], ids[at], times[at], how[at]))
                for b, at in packing.by_bucket((value >> np.uint64(64 - bits)).astype(np.int64), 1 << bits)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["bucket", "blob"])


def _counted(table: pa.Table, parts: int) -> pa.Table:
    """Of one bucket: per part, sums for each document; part -1: tokens and kinds; part -2: class tokens and their counts."""
    blobs = [packing.unpack(b.as_py(), 4) for b in table.column("blob")]
    value, ids, times, how = (np.concatenate([b[k] for b in blobs]) for k in range(4))
    times = times.astype(np.int64)
    kinds, at = np.unique(value, return_inverse=True)
    count = np.zeros(len(kinds), np.int64)
    np.add.at(count, at[how > 0], times[how > 0])
    classes = np.unique(at[how == 2])
    out = [(-1, packing.pack(np.array([count.sum()]), np.array([(count > 0).sum()]))), (-2, packing.pack(kinds[classes], count[classes]))]
    rare = how < 2
    ids, times, count = ids[rare], times[rare], count[at[rare]]
    order = np.argsort(ids, kind="stable")
    ids, times, count = ids[order], times[order], count[order]
    new = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
    if len(new):
        docs = ids[new]
        logs = np.add.reduceat(times * fixed(np.log10(count + 1)), new)
        known = np.add.reduceat(times * (count > 0), new)
        part = (textops.mix(docs) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((docs, part))
        for p, at in packing.by_bucket(part[order], parts):
            out.append((p, packing.pack(docs[order][at], logs[order][at].astype(np.uint64), known[order][at])))
    return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})


def _summed(table: pa.Table) -> pa.Table:
    blobs = [packing.unpack(b.as_py(), 3) for b in table.column("blob")]
    ids, logs, known = (np.concatenate([b[k] for b in blobs]) for k in range(3))
    kinds, at = np.unique(ids, return_inverse=True)
    sums = [np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)]
    np.add.at(sums[0], at, logs.astype(np.int64))
    np.add.at(sums[1], at, known.astype(np.int64))
    return pa.table({"id": kinds.view(np.int64), "logs": sums[0], "rare_known": sums[1]})


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("blob"):
            a, b = packing.unpack(blob.as_py(), 2)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])


@dataclass
class Frequent:
    """Classes of the model, tokens sorted by hash: classes 0..k-1, then other, end, and nothing before the start."""

    tokens: np.ndarray
    counts: np.ndarray
    end_count: int
    total: int
    kinds: int

    @property
    def other(self) -> int:
        return len(self.tokens)

    def classes(self, value: np.ndarray) -> np.ndarray:
        found = np.minimum(np.searchsorted(self.tokens, value), max(len(self.tokens) - 1, 0))
        out = np.full(len(value), self.other, np.int64)
        if len(self.tokens):
            out = np.where(self.tokens[found] == value, found, out)
        out[value == END] = self.other + 1
        return out

    def class_counts(self) -> np.ndarray:
        rest = self.total - self.counts.sum() - self.end_count
        return np.append(self.counts, [rest, self.end_count]).astype(float)

    def other_size(self) -> int:
        """Denominator for a token of the class of rare tokens."""
        return int(self.class_counts()[self.other]) + self.kinds - len(self.tokens) - (self.end_count > 0) + 1


def contexts(classes: np.ndarray, rows: np.ndarray, start: int) -> np.ndarray:
    """Classes of the tokens before each token, the nearest first; ``start`` before a row's first."""
    out = np.full((len(classes), CONTEXT), start, np.int64)
    for k in range(CONTEXT):
        out[k + 1 :, k] = np.where(rows[k + 1 :] == rows[: len(rows) - k - 1], classes[: len(rows) - k - 1], start)
    return out


def _scattered(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values by row."""
    return np.stack([np.bincount(rows, column, minlength=n) for column in values.T], 1)


@dataclass
class Model:
    vectors: np.ndarray  # of each class and of the start, as context and as target
    places: np.ndarray  # weights of each place before
    bias: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray) -> Model:
        rng = np.random.default_rng(11)
        share = (counts + 1) / (counts + 1).sum()
        return cls(rng.normal(0, 0.1, (2, len(counts) + 1, DIMENSIONS)), np.ones((CONTEXT, DIMENSIONS)) / CONTEXT, np.log(share))

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.places, self.bias]

    def predicted(self, context: np.ndarray) -> np.ndarray:
        return sum(self.vectors[0][context[:, k]] * self.places[k] for k in range(CONTEXT))

    def log_probabilities(self, context: np.ndarray) -> np.ndarray:
        """log10 of the probability of every class after each context; each row sums to one."""
        score = self.predicted(context) @ self.vectors[1][: len(self.bias)].T + self.bias
        score -= score.max(1, keepdims=True)
        return (score - np.log(np.exp(score).sum(1, keepdims=True))) / math.log(10)

    def learn(self, context: np.ndarray, target: np.ndarray, noise: np.ndarray, log_noise: np.ndarray, memory: list[np.ndarray]) -> None:
        """One step of noise-contrastive estimation: each token against ``noise`` drawn from ``log_noise``."""
        before = [self.vectors[0][context[:, k]] for k in range(CONTEXT)]
        made = sum(b * p for b, p in zip(before, self.places))
        log_k = math.log(len(noise))
        margin = lambda s, w: 1 / (1 + np.exp(-np.clip(s - log_k - log_noise[w], -30, 30)))
        real = 1 - margin((made * self.vectors[1][target]).sum(1) + self.bias[target], target)
        false = -margin(made @ self.vectors[1][noise].T + self.bias[noise], noise)
        size = len(target)
        to_made = real[:, None] * self.vectors[1][target] + false @ self.vectors[1][noise]
        grads = [np.zeros_like(p) for p in self.parameters()]
        grads[0][1] = _scattered(np.append(target, noise), np.concatenate((real[:, None] * made, false.T @ made)), len(self.vectors[1]))
        for k in range(CONTEXT):
            grads[0][0] += _scattered(context[:, k], to_made * self.places[k], len(self.vectors[0]))
            grads[1][k] = (to_made * before[k]).sum(0)
        grads[2] = np.bincount(np.append(target, noise), np.append(real, false.sum(0)), minlength=len(self.bias))
        for p, g, m in zip(self.parameters(), grads, memory):
            g /= size
            m += g * g
            p += RATE * g / np.sqrt(m + 1e-10)


def _trained(batches: Iterator[pa.RecordBatch], frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """Parameters after one pass over the partition's training tokens, times the number of tokens."""
    counts = frequent.class_counts()
    model, log_noise = Model.start(counts), np.log((counts + 1) / (counts + 1).sum())
    memory = [np.zeros_like(p) for p in model.parameters()]
    rng, seen = np.random.default_rng(3), 0
    draw = np.exp(log_noise)
    for batch in batches:
        for part in textops.slices(batch, "text"):
            value, rows = tokens(*textops.text_buffer(part.column("text")))
            classes = frequent.classes(value)
            context = contexts(classes, rows, frequent.other + 2)
            mixed = rng.permutation(len(classes))
            for k in range(0, len(mixed), BATCH):
                at = mixed[k : k + BATCH]
                model.learn(context[at], classes[at], rng.choice(len(draw), NOISE, p=draw), log_noise, memory)
            seen += len(classes)
    if seen:
        flat = np.concatenate([p.ravel() for p in model.parameters()]) * seen
        group = int(rng.integers(1 << 30))
        yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([seen]), pa.array([flat.tolist()], pa.list_(pa.float64()))], ["group", "seen", "flat"])


def _added(table: pa.Table) -> pa.Table:
    flat = np.zeros(len(table["flat"][0]))
    for row in table["flat"]:
        flat += np.asarray(row.values)
    return pa.table({"seen": [sum(table["seen"].to_pylist())], "flat": pa.array([flat.tolist()], pa.list_(pa.float64()))})


def train(training: DataFrame, frequent: Frequent) -> Model:
    """Average of the models of all partitions of ``training`` (text), weighted by tokens.

    One row of fixed size a partition is made; those are added in about as many
    groups as the square root of their number before the driver sees them.
    """
    model = Model.start(frequent.class_counts())
    width = max(1, math.isqrt(training.rdd.getNumPartitions()))
    each = training.select("text").mapInArrow(lambda b: _trained(b, frequent), "group long, seen long, flat array<double>")
    added = each.groupBy(F.pmod(F.xxhash64("group"), F.lit(width))).applyInArrow(_added, "seen long, flat array<double>").toArrow()
    seen = sum(added["seen"].to_pylist())
    if seen:
        flat = sum(np.asarray(row.values) for row in added["flat"]) / seen
        for p in model.parameters():
            p[...] = flat[: p.size].reshape(p.shape)
            flat = flat[p.size :]
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model, frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """Per document: tokens, rare tokens, log10 of the class probabilities, and the class tokens' part of the count logs."""
    base = len(model.bias) + 1
    logs = fixed(np.log10(np.append(frequent.counts, [0, frequent.end_count]) + 1.0))
    logs[frequent.other] = 0
    for batch in batches:
        for part in textops.slices(batch, "text"):
            value, rows = tokens(*textops.text_buffer(part.column("text")))
            classes = frequent.classes(value)
            context = contexts(classes, rows, frequent.other + 2)
            code = (context[:, 0] * base + context[:, 1]) * base + classes
            kinds, at = np.unique(code, return_inverse=True)
            chance = np.empty(len(kinds))
            pair, first = np.unique(kinds // base, return_index=True)
            edges = np.append(first, len(kinds))
            for k in range(0, len(pair), BATCH):
                some = pair[k : k + BATCH]
                table = model.log_probabilities(np.stack([some // base, some % base], 1))
                span = slice(edges[k], edges[min(k + BATCH, len(pair))])
                chance[span] = table[np.searchsorted(some, kinds[span] // base), kinds[span] % base]
            n = part.num_rows
            seen = np.zeros(n, np.int64)
            np.add.at(seen, rows, logs[classes])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"), part.column("doc_id"), part.column("held_out"), pa.array(np.bincount(rows, minlength=n)),
                    pa.array(np.bincount(rows, classes == frequent.other, minlength=n).astype(np.int64)),
                    pa.array(np.bincount(rows, chance[at], minlength=n)), pa.array(seen),
                ],
                ["id", "doc_id", "held_out", "n_tokens", "n_rare", "class_score", "class_logs"],
            )


def counted(rows: DataFrame) -> tuple[DataFrame, Frequent]:
    """(id, logs, rare_known) sums over the rare tokens of each row of (id, held_out, text), and the frequent tokens."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = deal_width(size // 8)
    parts = max(1, (1 << bits) // 4)
    classes = class_tokens(rows.filter(~F.col("held_out")))
    dealt = rows.select("id", "held_out", "text").mapInArrow(lambda b: _deal(b, bits, classes), "bucket int, blob binary")
    sums = storage.staged(dealt.groupBy("bucket").applyInArrow(lambda t: _counted(t, parts), "part int, blob binary"), "token-counts")
    total, kinds = sums.filter("part = -1").mapInArrow(_pairs, "a long, b long").agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    of_class = {r.a: r.b for r in sums.filter("part = -2").mapInArrow(_pairs, "a long, b long").collect()}  # CLASSES + 1 at most
    found = np.array([c for c in classes.view(np.int64).tolist() if c in of_class], np.int64)
    counts = np.array([of_class[c] for c in found.tolist()], np.int64)
    frequent = Frequent(found.view(np.uint64), counts, of_class.get(int(END), 0), total, kinds)
    of_docs = sums.filter("part >= 0").groupBy("part").applyInArrow(_summed, "id long, logs long, rare_known long")
    return of_docs, frequent


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    named, _ = with_ids(docs, key, text)
    rows = named.withColumn("held_out", held_out("doc_id"))
    of_docs, frequent = counted(rows)
    model = train(rows.filter(~F.col("held_out")), frequent)
    scored = rows.mapInArrow(
        lambda b: _scored(b, model, frequent),
        f"id long, doc_id {docs.schema[key].dataType.simpleString()}, held_out boolean, n_tokens long, n_rare long, class_score double, class_logs long",
    )
    both = scored.join(of_docs, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("logs", "rare_known")})
    total, rest = math.log10(frequent.total + frequent.kinds + 1), math.log10(frequent.other_size())
    unknown_end = 0 if frequent.end_count else 1
    return both.select(
        F.col("doc_id").alias(key), "held_out", "n_tokens", (F.col("n_tokens") - F.col("n_rare") - unknown_end + F.col("rare_known")).alias("n_known"),
        F.lit(frequent.total).cast("long").alias("train_tokens"),
        ((F.col("logs") + F.col("class_logs")) * UNIT - F.col("n_tokens") * total).alias("base_score"),
        (F.col("class_score") + F.col("logs") * UNIT - F.col("n_rare") * rest).alias("score"),
    )
