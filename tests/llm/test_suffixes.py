import hashlib
import random

import numpy as np
import pytest

from caseframe.llm import suffixes as X


def brute(rows):
    """Expected (key, n_bytes, n_removed, n_spans, sha) of each row."""
    big = 2**63
    texts = [(k, (t or "").encode()) for k, t in rows]
    least = {}
    for k, t in texts:
        for i in range(len(t) - 49):
            s = t[i : i + 50]
            least[s] = min(least.get(s, big), big - 1 if k is None else k)
    out = []
    for k, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < (big - 1 if k is None else k):
                gone[i : i + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((k, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in X.deduplicated(df, texts=False).collect()), key=repr)


def shared_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "é", "on ", "a", "東", "\n"]) for _ in range(rng.randint(1, 3)))
    make = lambda n: "".join(word() for _ in range(n))
    passages = [make(rng.choice([8, 15, 30, 120])) for _ in range(8)]
    texts = []
    for _ in range(50):
        parts = [rng.choice(passages)[rng.randint(0, 6) :] if rng.random() < 0.5 else make(rng.randint(0, 40)) for _ in range(rng.randint(0, 6))]
        texts.append("".join(parts))
    return texts + [rng.choice(texts) for _ in range(10)] + ["a" * 49, "a" * 50, "a" * 51, "b" * 400, "ab" * 200, "xb" * 30 + "b" * 100]


@pytest.mark.parametrize("seed", range(3))
def test_random_shared_passages(docs, seed, monkeypatch):
    if seed:  # several parts and buckets
        monkeypatch.setattr(X, "PART_BYTES", 3000)
        monkeypatch.setattr(X, "BUCKET_BYTES", 500)
    texts = shared_texts(seed)
    keys = random.Random(seed).sample(range(-500, 500), len(texts))
    rows = list(zip(keys, texts))
    assert got(docs(rows)) == brute(rows)


def test_edges_and_repeated_keys(docs):
    long = "the quick brown fox jumps over the lazy dog and runs away again"
    rows = [(3, long), (3, long), (3, "x" + long), (None, long), (None, long + "!"), (5, None), (6, ""), (2, long[:49]), (7, long[3:60])]
    assert got(docs(rows)) == brute(rows)
    rows = [(i, t) for i, t in enumerate([long, long, "z" * 30_000, "y" + "z" * 30_000])]
    df = docs(rows).selectExpr("doc_id", "text", "1 as id", "2 as part", "3 as blob", "4 as kept")
    assert got(df) == brute(rows)
    kept = {r.doc_id: bytes(r.kept).decode() for r in X.deduplicated(df).collect()}
    assert kept == {0: long, 1: "", 2: "z" * 30_000, 3: "y"}
    assert got(docs(["x"]).limit(0)) == []


def test_table(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    assert got(sf_docs) == brute(rows)


def test_cover_takes_any_two_places_into_the_sample():
    for a in range(31):
        for b in range(31):
            assert (a + X.SHIFT[a, b]) % 31 in X.COVER and (b + X.SHIFT[a, b]) % 31 in X.COVER


def test_suffix_order_is_lexicographic():
    rng = np.random.default_rng(4)
    runs = [rng.integers(97, 99, size=n).astype(np.uint8) for n in (50, 80, 300, 120)]
    runs += [runs[2].copy(), np.full(200, 97, np.uint8), np.full(90, 97, np.uint8), runs[2][20:150].copy()]
    text = np.concatenate(runs)
    length = np.array([len(r) for r in runs])
    begin = np.cumsum(length) - length
    starts = X._ranges(begin, length - 49)
    ends = np.repeat(begin + length, length)
    order, equal = X.suffix_order(text, ends, starts)
    strings = [text[s : s + 50].tobytes() for s in starts[order]]
    assert strings == sorted(strings)
    assert equal.tolist() == [False] + [a == b for a, b in zip(strings, strings[1:])]
