import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from caseframe.llm import loglinear as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2


def split(text):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), ""]


def brute(rows):
    count = Counter(t for i, text in rows if not held(i) for t in split(text))
    n, v = sum(count.values()), len(count)
    return [
        (i, held(i), len(ts := split(text)), sum(count[t] > 0 for t in ts), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts))
        for i, text in rows
    ]


def check(df, rows):
    got = sorted((tuple(r) for r in L.scores(df).collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=0, atol=1e-5)
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)
    return got


def test_table_and_held_out_gain(sf_docs):
    got = check(sf_docs, [(r.doc_id, r.text) for r in sf_docs.collect()])
    assert sum(g[6] for g in got if g[1]) > sum(g[5] for g in got if g[1])


def test_edges_repeated_and_missing_ids(docs):
    rows = [(1, "a b A"), (1, "a b A"), (2, None), (3, ""), (None, "a zz"), (None, None), (4, "\x0b é É\u0085 東"), (5, "q" * 70_000), (9, "a"), (-2, "b")]
    check(docs(rows), rows)


def test_empty_table_and_nothing_to_learn(docs):
    assert L.scores(docs(["x"]).limit(0)).count() == 0
    only = next(i for i in range(100) if held(i))
    rows = [(only, "a b")]
    got = check(docs(rows), rows)
    assert got[0][3] == 0 and got[0][4] == 0


def test_clashing_columns(docs):
    rows = list(enumerate(["a b", "b c", "c"]))
    check(docs(rows).selectExpr("doc_id", "text", "1 as id", "2 as held_out", "3 as logs", "4 as n_tokens"), rows)


def test_probabilities_are_normalised():
    model = L.Model.start(np.array([5.0, 3, 2, 9]))
    model.vectors += 0.3
    context = np.array([[0, 1], [4, 4], [3, 2]])
    assert np.allclose((10 ** model.log_probabilities(context)).sum(1), 1)
    frequent = L.Frequent(np.array([7, 9], np.uint64), np.array([5, 3]), end_count=2, total=20, kinds=8)
    # known rare tokens (10 occurrences of 5 kinds) and one unknown token share the class
    assert frequent.other_size() == 10 + 5 + 1


def test_contrastive_estimation_learns_a_pattern():
    rng = np.random.default_rng(0)
    n = 40_000
    classes = np.empty(n, np.int64)
    classes[0] = 0
    for i in range(1, n):  # the next class mostly follows from the one before
        classes[i] = (classes[i - 1] + 1) % 4 if rng.random() < 0.9 else rng.integers(4)
    counts = np.bincount(classes, minlength=4).astype(float)
    model, noise = L.Model.start(counts), np.log(counts / n)
    memory = [np.zeros_like(p) for p in model.parameters()]
    context = L.contexts(classes, np.zeros(n), 4)
    for _ in range(3):
        for k in range(0, n, 512):
            model.learn(context[k : k + 512], classes[k : k + 512], rng.choice(4, 32, p=counts / n), noise, memory)
    score = model.log_probabilities(context)[np.arange(n), classes].mean()
    assert score > 0.6 * math.log10(0.25)


@pytest.mark.parametrize("rows", [[0, 0, 1, 1, 1], [0, 1, 2, 3, 4]])
def test_contexts_do_not_cross_rows(rows):
    out = L.contexts(np.arange(5), np.array(rows), 9)
    want = [[j if (j := i - 1) >= 0 and rows[j] == rows[i] else 9, j if (j := i - 2) >= 0 and rows[j] == rows[i] else 9] for i in range(5)]
    assert out.tolist() == want


@pytest.mark.parametrize("held", [1 << 20, 500])
def test_classes_are_the_most_frequent_tokens_of_all(spark, monkeypatch, held):
    """A token that is frequent over all, but in no partition among its first 2048."""
    monkeypatch.setattr(L, "HELD_KINDS", held)
    texts = [" ".join(f"w{p}x{i} w{p}x{i}" for i in range(2100)) + "".join(f" everywhere{k}" for k in range(200)) for p in range(3)]
    found = L.class_tokens(spark.createDataFrame([(t,) for t in texts], "text string").repartitionByRange(3, "text"))
    raw = np.frombuffer(" ".join(f"everywhere{k}" for k in range(200)).encode(), np.uint8)
    every, _ = L.tokens(raw, np.array([0, len(raw)]))
    assert len(found) == L.CLASSES and np.isin(every[every != L.END], found).all()
