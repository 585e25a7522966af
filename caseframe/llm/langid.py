"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are runs of three and four bytes inside a word and its borders, hashed
to ``BUCKETS``. A document is the mean embedding of its subwords; embeddings and
softmax are trained by stochastic gradient descent in numpy on a bounded sample
of labelled documents. A part of the sample is held back: it fits a temperature,
so that the score is a calibrated probability, and the least score from which
predictions are right often enough; below it a prediction is not ``accepted``.
As everything after the embedding is linear, prediction needs one table of
``BUCKETS`` by languages.

Texts that are null or without letter are ``und`` with score 0. Ties go to the
language that comes first by name. Without any labelled row all texts are
``und``. A row without ``doc_id`` is never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe.llm import textops

BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 6
RATE = 0.5
#: Bound of the training sample: labelled documents of a language, chosen by a hash of their id.
SAMPLE_PER_LANGUAGE = 1000
#: Share of the sample that calibrates, and the precision that accepted predictions should have.
HELD_BACK = 5
PRECISION = 0.98
UNKNOWN = "und"
FOLDS = 5


def held_out(key: str, folds: int = FOLDS, fold: int = 0) -> Column:
    """Whether a document is kept out of the learning: the remainder of its id's CRC-32."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(True))


def subwords(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the rows, and their rows (ascending)."""
    lower = textops.lower_table()[raw]
    letter = ((lower >= ord("a")) & (lower <= ord("z"))) | (lower >= 0x80)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(raw)) + 2 * rows + 1
    codes, inside = np.zeros(len(raw) + 2 * (len(offsets) - 1), np.uint64), None
    codes[at] = np.where(letter, lower, 0)
    inside = codes > 0
    owner = np.zeros(len(codes), np.int64)
    owner[at] = rows
    found = []
    for n in (3, 4):
        m = len(codes) - n + 1
        if m <= 0:
            continue
        ok = inside[1 : m + 1] & inside[n - 2 : m + n - 2]  # all inner bytes belong to a word
        start = np.flatnonzero(ok)
        value = np.full(len(start), n, np.uint64)
        for k in range(n):
            value = value << np.uint64(8) | codes[start + k]
        found.append((textops.mix(value) >> np.uint64(64 - 15), owner[start + 1]))
    buckets, of = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(of, kind="stable")
    return buckets[order].astype(np.int64), of[order]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets by languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        buckets, rows = subwords(raw, offsets)
        n = len(offsets) - 1
        count = np.bincount(rows, minlength=n)
        sums = np.zeros((n, len(self.languages)))
        some = count > 0
        if len(rows):
            sums[some] = np.add.reduceat(self.table[buckets], (np.cumsum(count) - count)[some], axis=0)
        return sums / np.maximum(count, 1)[:, None] + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets and their counts for each document."""
    for batch in batches:
        for part in textops.slices(batch, "text"):
            buckets, rows = subwords(*textops.text_buffer(part.column("text")))
            keys, counts = np.unique(rows * BUCKETS + buckets, return_counts=True)
            ends = np.cumsum(np.bincount(keys // BUCKETS, minlength=part.num_rows))
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("lang"), part.column("order"),
                    pa.ListArray.from_arrays(offsets, (keys % BUCKETS).astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, counts.astype(np.int32)),
                ],
                ["lang", "order", "buckets", "counts"],
            )


BAGS = "lang string, order long, buckets array<int>, counts array<int>"


def sample(labelled: DataFrame) -> DataFrame:
    """Bags of at most about ``SAMPLE_PER_LANGUAGE`` documents of each language, whole texts."""
    sizes = labelled.groupBy("lang").count().collect()  # as many rows as the model has classes
    if not sizes:
        return labelled.select("lang", F.lit(0).cast("long").alias("order"), "text").mapInArrow(_bags, BAGS)
    rate = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, SAMPLE_PER_LANGUAGE / r["count"]))))
    ranked = labelled.withColumn("order", F.xxhash64("doc_id", F.lit("sample")))
    chosen = ranked.filter((F.col("order") / 2.0**64 + 0.5) < rate[F.col("lang")])
    return chosen.select("lang", "order", "text").mapInArrow(_bags, BAGS)


def fit(bags: pa.Table) -> Model | None:
    """Train on the bags; None if there is none."""
    order = np.argsort(bags["order"].to_numpy(), kind="stable")
    names = bags["lang"].to_pylist()
    languages = sorted(set(names))
    if not languages:
        return None
    label = np.array([languages.index(x) for x in names])
    lists = [bags[c].combine_chunks() for c in ("buckets", "counts")]
    docs = [(np.asarray(lists[0][int(i)].values), np.asarray(lists[1][int(i)].values, np.float64), label[i]) for i in order]
    docs = [(b, c / c.sum(), y) for b, c, y in docs if len(b)]
    back = docs[::HELD_BACK] if len(docs) >= 10 * HELD_BACK else docs
    front = [d for k, d in enumerate(docs) if k % HELD_BACK] if len(docs) >= 10 * HELD_BACK else docs
    rng = np.random.default_rng(7)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weight, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    weight += rng.normal(0, 0.1, weight.shape)
    share = np.bincount([y for *_, y in front], minlength=len(languages)) / max(len(front), 1)
    scale = 1 / np.maximum(share * len(languages), 1e-9)  # every language counts alike
    steps, step = EPOCHS * len(front), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(front)):
            buckets, part, y = front[k]
            rate = RATE * (1 - step / steps) * min(scale[y], 4.0)
            step += 1
            mean = part @ embed[buckets]
            error = softmax(mean @ weight + bias)
            error[y] -= 1
            back_to = weight @ error
            weight -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            embed[buckets] -= rate * BUCKETS**0.5 * part[:, None] * back_to
    table = embed @ weight
    logits = np.array([part @ table[b] + bias for b, part, _ in back]).reshape(-1, len(languages))
    truth = np.array([y for *_, y in back], int)
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    temperature = float(min(np.geomspace(0.2, 20, 60), key=loss)) if len(truth) else 1.0
    scores = softmax(logits / temperature) if len(truth) else logits
    right = scores.argmax(1) == truth if len(truth) else np.zeros(0, bool)
    best = scores.max(1) if len(truth) else np.zeros(0)
    threshold = 0.0
    by_score = np.argsort(-best)
    precision = np.cumsum(right[by_score]) / np.arange(1, len(best) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    if len(good) and good[-1] + 1 < len(best):
        threshold = float(best[by_score[good[-1]]])
    return Model(languages, table.astype(np.float32), bias, temperature, threshold)


def train(df: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> Model | None:
    """A model of the labelled documents outside the held-out fold."""
    labelled = df.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        ~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    return fit(sample(labelled).toArrow())


def predict(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, held_out, lang_pred, score, accepted."""
    source = df.select(F.col(key), held_out(key).alias("held_out"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered"), F.col(text).alias("text"))
    if model is None:
        return source.select(key, "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS by languages
    schema = T.StructType([
        df.schema[key], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            for part in textops.slices(batch, "text", max(1 << 16, textops.CHUNK_BYTES * 4 // max(4, len(m.languages)))):
                chance = softmax(m.logits(*textops.text_buffer(part.column("text"))) / m.temperature)
                lettered = np.asarray(part.column("lettered").to_numpy(zero_copy_only=False), bool)
                best = np.where(lettered, chance.argmax(1), len(m.languages))
                score = np.where(lettered, chance.max(1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key), part.column("held_out"), pa.array(names[best].tolist(), pa.string()),
                        pa.array(score), pa.array(lettered & (score >= m.threshold)),
                    ],
                    schema.names,
                )

    return source.mapInArrow(run, schema)


def identified(df: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Train on the labelled documents outside the held-out fold and predict all."""
    return predict(df, train(df, key, lang, text), key, text)
