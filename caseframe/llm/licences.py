"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph lies between blank lines. What is classified are its lines, and its
runs of ``UNIT_WORDS`` words that cross a line end (overlapping by half, as are
those of a longer line), so that wrapped text is seen in both ways. The
classifier is a multinomial logistic regression over hashed word 1- to 3-grams.
It is trained in numpy on statements made from the licence names and phrases
below (with and without words of the corpus around them), on runs of the licence
bodies, on statements that name no known licence (class ``unknown``), and on a
bounded sample of runs of the corpus (class ``none``). A held-back part of these
fits the temperature of the probabilities. A family with a chance of
``POSSIBLE`` or more is confirmed by comparison with its templates: a name is
held word for word, or at least ``CONTAINED`` of the run's word
``TEMPLATE_WORDS``-grams stand in the family's body. Without a confirmed family
a run is ``unknown`` if it is likelier a licence than not and has a general
licence word.

Null and empty texts have no paragraphs. Rows are independent; keys may repeat.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe.llm import spans as S
from caseframe.llm import textops
from caseframe.llm.langid import softmax
from caseframe.llm.licence_texts import BODIES

BUCKETS = 1 << 16
NGRAMS = 3
UNIT_WORDS = 32
EPOCHS = 30
RATE = 2.0
#: Bound of the corpus sample: about so many runs that hold no licence word, as examples of ``none``.
SAMPLE = 4000
SAMPLE_CHARS = 2000
#: A licence needs this probability, and a family that the templates confirm the lower one.
CONFIDENT, POSSIBLE = 0.5, 0.1
TEMPLATE_WORDS, LEAST_GRAMS, CONTAINED = 4, 3, 0.5
NONE, UNKNOWN = "none", "unknown"

#: Names by which licences are stated; public names, in lower case.
NAMES = {
    "agpl": ("gnu affero general public license", "agpl-3.0", "agplv3"),
    "apache": ("apache license", "apache-2.0", "apache software license"),
    "bsd": ("bsd license", "bsd 3-clause license", "bsd 2-clause license", "bsd-3-clause", "bsd-2-clause"),
    "cc-by": ("creative commons attribution 4.0 international license", "cc by 4.0", "cc-by-4.0"),
    "cc-by-nc": ("cc by-nc 4.0", "cc-by-nc-4.0", "creative commons attribution-noncommercial 4.0 international license"),
    "cc-by-sa": ("cc by-sa 4.0", "cc-by-sa-4.0", "creative commons attribution-sharealike 4.0 international license"),
    "cc0": ("cc0 1.0", "cc0-1.0", "creative commons zero", "public domain dedication"),
    "gpl": ("gnu general public license", "gpl-3.0", "gpl-2.0", "gplv3", "gplv2"),
    "isc": ("isc license",),
    "lgpl": ("gnu lesser general public license", "lgpl-2.1", "lgpl-3.0"),
    "mit": ("mit license", "license: mit", "licence: mit"),
    "mpl": ("mozilla public license", "mpl-2.0"),
    "reserved": ("all rights reserved", "proprietary and confidential"),
    "unlicense": ("the unlicense", "released into the public domain"),
}
#: Phrases around a name.
PHRASES = (
    "licensed under the {}", "licensed under {}", "released under the {}", "released under {}", "distributed under the terms of the {}",
    "this work is licensed under the {}", "this work is licensed under a {}", "this program is free software under the {}", "{}",
    "spdx-license-identifier: {}", "see the {} for details", "licensed under the {}, version 2.0", "licensed under the {}, version 3",
    "available under the {} or later", "subject to the {}", "copyright (c) the authors, {}",
)
CLASSES = (NONE, UNKNOWN, *NAMES)
UNKNOWN_NAMES = ("{} license", "{} public license", "{} community licence", "{}-1.0", "{} software license", "{} open data licence")
#: Beginnings of the words that every statement of an unlisted licence holds one of.
GENERIC = ("license", "licence", "licensing", "licencing", "copyright", "spdx")
LICENCE_WORD = r"(?i)licen[sc]e|copyright|all rights reserved|public domain|spdx|proprietary|\bcc[ -]|\bcc0|gpl|general public|mozilla public|\bpermi(?:ssion|tted)|redistribut|warrant|liab(?:le|ility)"


def _words(line: str) -> list[str]:
    """Lower-cased words without the marks around them."""
    return [w for w in (x.strip(".,;:!?\"'()[]{}<>*#|") for x in line.lower().split()) if w]


def _crossing(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) word of the runs of a paragraph that cross a line end."""
    n = len(starts)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    feeds = np.concatenate(([0], np.cumsum(raw == 0x0A)))
    line = feeds[starts]  # line feeds before each word
    row = np.searchsorted(offsets, starts, side="right") - 1
    opens = np.concatenate(([True], (line[1:] - line[:-1] > 1) | (row[1:] != row[:-1])))
    first = np.flatnonzero(opens)
    last = np.concatenate((first[1:], [n]))
    runs = np.maximum(1, -(-(last - first - UNIT_WORDS) // step) + 1)
    nth = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    begin = np.repeat(first, runs) + nth * step
    end = np.minimum(begin + UNIT_WORDS, np.repeat(last, runs))
    crosses = line[begin] != line[end - 1]
    return begin[crosses], end[crosses]


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word n-gram buckets of the units of all rows with their units (ascending); row, first and last byte of each unit."""
    lower = textops.lower_table()[raw]
    inside = ((lower >= ord("a")) & (lower <= ord("z"))) | ((lower >= ord("0")) & (lower <= ord("9"))) | (lower >= 0x80) | (lower == ord("-"))
    line_starts, line_ends, line_rows = textops.runs(raw != 0x0A, offsets)
    starts, ends, _ = textops.runs(inside, np.unique(np.concatenate((offsets, line_starts))))
    words = textops.segment_hash(lower, starts, ends)
    first, last = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    step = UNIT_WORDS // 2
    runs = np.where(last > first, np.maximum(1, -(-(last - first - UNIT_WORDS) // step) + 1), 0)
    unit_line = np.repeat(np.arange(len(line_starts)), runs)
    nth = np.arange(len(unit_line)) - np.repeat(np.cumsum(runs) - runs, runs)
    begin = first[unit_line] + nth * step
    end = np.minimum(begin + UNIT_WORDS, last[unit_line])
    crossing = _crossing(raw, starts, ends, offsets, step)
    unit_row = np.concatenate((line_rows[unit_line], np.searchsorted(offsets, starts[crossing[0]], side="right") - 1))
    begin, end = np.concatenate((begin, crossing[0])), np.concatenate((end, crossing[1]))
    buckets, owners = [], []
    for n in range(1, NGRAMS + 1):
        size = np.maximum(end - begin - n + 1, 0)
        unit = np.repeat(np.arange(len(begin)), size)
        at = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size) + begin[unit]
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = value * textops.ODD + words[at + k]
        buckets.append((textops.mix(value) >> np.uint64(48)).astype(np.int64))
        owners.append(unit)
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    left = starts[np.minimum(begin, max(len(starts) - 1, 0))] if len(starts) else begin
    right = ends[end - 1] if len(ends) else end
    return bucket[order], owner[order], unit_row, left, right


@dataclass
class Model:
    weights: np.ndarray  # buckets by classes
    bias: np.ndarray
    temperature: float

    def chances(self, bucket: np.ndarray, unit: np.ndarray, units: int) -> np.ndarray:
        count = np.bincount(unit, minlength=units)
        sums = np.zeros((units, len(self.bias)))
        if len(unit):
            some = count > 0
            sums[some] = np.add.reduceat(self.weights[bucket], (np.cumsum(count) - count)[some], axis=0)
        return softmax((sums / np.sqrt(np.maximum(count, 1))[:, None] + self.bias) / self.temperature)


def examples(negatives: list[str], seed: int = 5) -> list[tuple[str, int]]:
    """Training paragraphs and classes: made statements, and the corpus sample as ``none``."""
    rng = np.random.default_rng(seed)
    pool = [w for line in negatives for w in line.split()] or ["and", "of", "text"]
    noise = lambda n: " ".join(pool[i] for i in rng.integers(len(pool), size=n))
    around = lambda s: f"{noise(rng.integers(0, 9))} {s} {noise(rng.integers(0, 9))}" if rng.random() < 0.6 else s
    made = []
    for family, names in NAMES.items():
        for name in names:
            for phrase in PHRASES:
                made += [(around(phrase.format(name)), CLASSES.index(family)) for _ in range(2)]
    for k in range(600):
        word = noise(rng.integers(1, 3))
        made.append((around(PHRASES[k % len(PHRASES)].format(UNKNOWN_NAMES[k % len(UNKNOWN_NAMES)].format(word))), 1))
    for family, bodies in BODIES.items():
        for body in bodies:
            words = body.split()
            for k in range(0, max(len(words) - UNIT_WORDS // 2, 1), 4):
                for size in (UNIT_WORDS, UNIT_WORDS // 2):
                    made.append((around(" ".join(words[k : k + size])), CLASSES.index(family)))
    for line in negatives:
        words = line.split()
        for k in range(0, max(len(words), 1), UNIT_WORDS):
            made.append((" ".join(words[k : k + UNIT_WORDS]), 0))
    return [(s.replace("\n", " "), c) for s, c in made]


def fit(negatives: list[str]) -> Model:
    """Stochastic gradient descent over the examples; every fifth is held back for the temperature."""
    made = [x for x in examples(negatives) if x[0].strip()]
    rng = np.random.default_rng(9)
    made = [made[i] for i in rng.permutation(len(made))]
    raw = "\n".join(s for s, _ in made).encode()
    lengths = [len(s.encode()) + 1 for s, _ in made]
    offsets = np.minimum(np.concatenate(([0], np.cumsum(lengths))), len(raw))
    bucket, unit, row, _, _ = features(np.frombuffer(raw, np.uint8), offsets)
    edges = np.searchsorted(unit, np.arange(len(row) + 1))
    label = np.array([c for _, c in made])[row]
    weights, bias = np.zeros((BUCKETS, len(CLASSES))), np.zeros(len(CLASSES))
    train = np.flatnonzero(row % 5 > 0)
    scale = len(train) / len(CLASSES) / np.maximum(np.bincount(label[train], minlength=len(CLASSES)), 1)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 4)
        for u in rng.permutation(train):
            at = bucket[edges[u] : edges[u + 1]]
            if not len(at):
                continue
            norm = 1 / np.sqrt(len(at))
            error = softmax(weights[at].sum(0) * norm + bias)
            error[label[u]] -= 1
            error *= rate * min(max(scale[label[u]], 0.5), 2.0)
            np.subtract.at(weights, at, error * norm)
            bias -= 0.02 * error
    model = Model(weights.astype(np.float32), bias, 1.0)
    back = np.flatnonzero(row % 5 == 0)
    if len(back):
        logits = np.log(np.maximum(model.chances(bucket, unit, len(row)), 1e-12))[back]
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(back)), label[back]], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.3, 10, 40), key=loss))
    return model


def train(df: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """A model of the made statements and about ``SAMPLE`` runs of words of the corpus, chosen by hash.

    The share to choose comes from a count, so the tasks send no more than the sample together.
    """
    lines = df.select(F.col(key).alias("k"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    lines = lines.filter(~F.col("line").rlike(LICENCE_WORD) & (F.length(F.trim("line")) > 0))
    share = min(1.0, SAMPLE / max(lines.count(), 1))
    order = F.xxhash64("k", "at", "line", F.lit("licence"))
    chosen = lines.filter(order / 2.0**64 + 0.5 < share).select(order.alias("order"), F.split(F.trim("line"), r"\s+").alias("w"))
    begin = F.pmod(F.col("order"), F.greatest(F.size("w") - UNIT_WORDS, F.lit(0)) + 1).cast("int") + 1
    run = F.left(F.array_join(F.slice("w", begin, F.lit(UNIT_WORDS)), " "), F.lit(SAMPLE_CHARS))
    return fit([r.run for r in chosen.select("order", run.alias("run")).orderBy("order", "run").collect()])


def _grams(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + TEMPLATE_WORDS]) for k in range(len(words) - TEMPLATE_WORDS + 1)}


@lru_cache
def _body_grams(family: str) -> frozenset[tuple[str, ...]]:
    return frozenset().union(*(_grams(_words(body)) for body in BODIES.get(family, ())))


def contained(words: list[str], family: str) -> float:
    """The share of the run's word n-grams that stand in the family's body; fewer than ``LEAST_GRAMS`` tell nothing."""
    grams = _grams(words)
    return len(grams & _body_grams(family)) / len(grams) if len(grams) >= LEAST_GRAMS else 0.0


def named(words: list[str], family: str) -> bool:
    """Whether the words hold one of the family's names word for word."""
    for name in NAMES[family]:
        wanted = _words(name)
        if any(words[k : k + len(wanted)] == wanted for k in range(len(words) - len(wanted) + 1)):
            return True
    return False


def confirmed(paragraph: str, family: str) -> bool:
    """Whether the run holds one of the family's names, or is mostly a part of its body.

    A name within one line is that line's finding: in a run over line ends only the other lines are compared.
    """
    lines = [_words(line) for line in paragraph.split("\n")]
    rest = [w for line in lines if len(lines) == 1 or not named(line, family) for w in line]
    return named(rest, family) or contained(rest, family) >= CONTAINED


def decide(chances: np.ndarray, paragraph: str) -> str | None:
    """Family, unknown, or None for no licence."""
    words, best = _words(paragraph), int(chances[2:].argmax()) + 2
    if chances[0] >= CONFIDENT or chances[best] + chances[1] < CONFIDENT:
        return None
    if chances[best] >= CONFIDENT and confirmed(paragraph, CLASSES[best]):
        return CLASSES[best]
    others = [c for c in np.argsort(-chances) if c > 1 and chances[c] >= POSSIBLE and confirmed(paragraph, CLASSES[c])]
    if others:
        return CLASSES[others[0]]
    return UNKNOWN if any(w.startswith(GENERIC) for w in words) else None


def found(text: str, raw: np.ndarray, model_units: list[tuple[int, int, np.ndarray]]) -> list[S.Span]:
    """Spans of the licences of one text, from its units (first byte, last byte, chances); overlapping units count once."""
    out: list[S.Span] = []
    begins = np.cumsum((raw & 0xC0) != 0x80)  # characters up to each byte
    for a, b, chances in sorted(model_units, key=lambda u: (u[0], u[1])):
        family = decide(chances, raw[a:b].tobytes().decode())
        if family:
            start = int(begins[a]) - 1
            out.append((start, start + int(begins[b - 1] - begins[a]) + 1, family))
    known = [s for s in out if s[2] != UNKNOWN]  # a run that also lies in a known one is not unknown
    out = [s for s in out if s[2] != UNKNOWN or not any(s[0] < t[1] and t[0] < s[1] for t in known)]
    merged: list[S.Span] = []
    for span in sorted(out, key=lambda s: (s[2], s[0], s[1])):
        if merged and merged[-1][2] == span[2] and span[0] < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(span[1], merged[-1][1]), span[2])
        else:
            merged.append(span)
    # Families share wording: what lies within a longer finding of another family is a part of that.
    inside = lambda s, t: t[0] <= s[0] and s[1] <= t[1] and t[1] - t[0] > s[1] - s[0]
    return sorted(s for s in merged if not any(inside(s, t) for t in merged if t[2] != s[2]))


def scan(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns, ``paragraphs`` (number classified) and ``licences`` (spans)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS by CLASSES
    keep = [f for f in df.schema.fields if f.name not in ("paragraphs", "licences")]
    schema = T.StructType([*keep, T.StructField("paragraphs", T.LongType()), T.StructField("licences", S.SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, text, textops.CHUNK_BYTES // 2):
                raw, offsets = textops.text_buffer(part.column(text))
                bucket, unit, row, left, right = features(raw, offsets)
                chances = shared.value.chances(bucket, unit, len(row))
                feeds = np.concatenate(([0], np.cumsum(raw == 0x0A)))
                lines = row[feeds[left] == feeds[right]] if len(row) else row
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                likely = np.flatnonzero(chances[:, 0] < CONFIDENT)
                for r in np.unique(row[likely]):
                    a, b = offsets[r], offsets[r + 1]
                    own = [(int(left[u] - a), int(right[u] - a), chances[u]) for u in likely[row[likely] == r]]
                    spans[r] = [{"kind": k, "start": s, "end": e} for s, e, k in found("", raw[a:b], own)]
                from pyspark.sql.pandas.types import to_arrow_type

                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(f.name) for f in keep), pa.array(np.bincount(lines, minlength=part.num_rows).astype(np.int64)),
                        pa.array(spans, to_arrow_type(S.SPANS)),
                    ],
                    schema.names,
                )

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: paragraphs, n_licences, n_unknown, families (sorted, comma-joined), spans."""
    named = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    got = scan(named, train(named, "key"))
    kinds = F.transform("licences", lambda s: s["kind"])
    return got.select(
        F.col("key").alias(key), F.col("paragraphs").alias("n_paragraphs"), F.size("licences").cast("long").alias("n_licences"),
        F.size(F.filter(kinds, lambda k: k == UNKNOWN)).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("families"),
        F.array_join(F.transform("licences", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",").alias("spans"),
    )
