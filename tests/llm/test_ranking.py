"""Ranked search against a scan of all documents for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from caseframe.llm import ranking

ITEMS = "item_id long, text string"


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(ranking.TERM, lower)


def brute(rows, items, k=20):
    docs = [(key, Counter(terms(text))) for key, text in rows]
    sizes = [sum(c.values()) for _, c in docs]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for (key, counts), size in zip(docs, sizes):
            score = 0
            for t, times in Counter(terms(text)).items():
                if counts[t]:
                    m = 100 - 25 + (25 * size * n) // total
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 12 * m))
            if score > 0:
                scored.append((-score, key is None, key))
        out += [(item, r + 1, key, -s) for r, (s, _, key) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def got(docs, items, **options):
    return sorted(map(tuple, ranking.ranked(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def some_texts(seed, n=300):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "a", "in", "to"], [f"w{i}" for i in range(200)]
    word = lambda: rng.choice(common) if rng.random() < 0.6 else rng.choice(rare)
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(n)]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 12)))) for i in range(25)]
    return list(enumerate(texts)), items


@pytest.mark.parametrize("seed,options", [(0, {}), (1, {"shard_bytes": 800}), (2, {"shard_bytes": 300, "item_bytes": 200}), (3, {"k": 3})])
def test_random_texts(spark, docs, seed, options):
    rows, items = some_texts(seed)
    assert got(docs(rows, 4), spark.createDataFrame(items, ITEMS), **options) == brute(rows, items, options.get("k", 20))


def test_ties_nulls_long_texts_and_repeats(spark, docs):
    texts = [None, "", "...", "same words here", "same words here", "Same WORDS here!", "ä ß Straße", "x9 9x", "word " * 200_000, "z" * 500_000]
    rows = list(enumerate(texts)) + [(None, "same words here"), (3, "other words"), (3, "other words"), (77, "same words here " * 3)]
    items = [(1, "same"), (2, "WORDS words other"), (3, None), (4, "nowhere"), (5, ""), (None, "straße Ä"), (6, "z" * 500_000), (7, "word"), (2, "here")]
    frame = spark.createDataFrame(items, ITEMS)
    assert got(docs(rows), frame) == brute(rows, items)
    many = [(i, "tie text") for i in range(90)]
    assert got(docs(many, 7), spark.createDataFrame([(1, "tie")], ITEMS), shard_bytes=50) == brute(many, [(1, "tie")])


def test_table_empty_tables_and_other_columns(spark, docs, sf, sf_docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in sf_docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(sf_docs, items, shard_bytes=50_000) == want
    assert got(sf_docs.limit(0), items) == [] == got(sf_docs, items.limit(0))
    clash = docs(["a b", "b"]).selectExpr("doc_id", "text", "1 as ids", "2 as key", "3 as score", "4 as item", "5 as rank")
    assert got(clash, spark.createDataFrame([(1, "a")], ITEMS)) == brute([(0, "a b"), (1, "b")], [(1, "a")])


def test_pair_bounds_hold_and_are_tighter(spark, docs):
    """No document's share of a set of terms exceeds the set's bound, and disjoint common terms do not add up."""
    rows = [(i, f"left {'l' * (i % 7 + 1)}" if i % 2 else f"right {'r' * (i % 5 + 1)}") for i in range(200)]
    vocabulary = ranking.Vocabulary([b"left", b"right", b"l", b"rr"])
    shards = ranking.postings(docs(rows, 1), "doc_id", "text", vocabulary)
    df = ranking.document_counts(shards, 4)
    assert {t: int(df[i]) for t, i in vocabulary.numbers.items()} == Counter(t.encode() for _, x in rows for t in set(terms(x)) if t in ("left", "right", "l", "rr"))
    index = ranking.bounded(shards, ranking.weights(df, 200), 200, 400).collect()[0]
    shard = ranking.Shard({c: bytes(index[c]) for c in ("held", "ends", "docs", "gains", "tops", "common", "joint")}, 200)
    used = sorted((shard.tops[p], p, 1) for p in range(4))
    bounds = shard.prefix_bounds(used, 1 << 60)
    score = np.zeros(200, np.int64)
    for k, (_, p, _) in enumerate(used):
        at = shard.list_of(p)
        score[shard.docs[at]] += shard.gains[at]
        assert score.max() <= bounds[k + 1]
    assert bounds[-1] < sum(t for t, _, _ in used)


def test_vocabulary_with_one_hash_for_two_terms():
    words = ranking.Vocabulary([b"aa", b"bb", b"cc"])
    words.hashes = np.full(3, 7, np.uint64)
    words.widest = 3
    raw = np.frombuffer(b"bbccxxaa", np.uint8)
    starts = np.arange(0, 8, 2)
    hashed, ranking.textops.segment_hash = ranking.textops.segment_hash, lambda *a: np.full(4, 7, np.uint64)
    try:
        found = words.find(raw, starts, starts + 2)
    finally:
        ranking.textops.segment_hash = hashed
    assert [words.terms[i] if i >= 0 else None for i in found] == [b"bb", b"cc", None, b"aa"]
