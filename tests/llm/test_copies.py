"""Exact copies against a dictionary of texts."""

import hashlib
import random

import numpy as np
import pytest

from caseframe.llm import copies


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(lower(text), []).append(key)
    out = []
    for text, keys in groups.items():
        known = [k for k in keys if k is not None]
        keep = max(known) if known else None
        stay = keys.index(keep)
        out += [(k, keep, len(keys), i == stay, hashlib.sha256(text.encode()).hexdigest()) for i, k in enumerate(keys)]
    return sorted(out, key=repr)


def got(frame, **options):
    return sorted(map(tuple, copies.exact_copies(frame, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("width", [1, 5, 17, 48, 63, 64])
def test_golomb_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (1, 2, 60, 2000):
        values = np.unique(rng.integers(0, (1 << width) - 1, n, dtype=np.uint64, endpoint=True))
        assert (copies.golomb_values(copies.golomb(values, width)) == values).all()
    many = np.unique(rng.integers(0, 1 << 62, 5000, dtype=np.uint64))
    assert len(copies.golomb(many, 62)) < 0.9 * 8 * len(many)


def some_rows():
    rng = random.Random(2)
    texts = ["", None, "A b", "a B", "ä", "Ä", "x" * 2_000_000, "X" * 2_000_000, " a b", "\0", "a\0"]
    texts += [rng.choice(["same text", "SAME text", f"only {i}", f"twice {i // 2}"]) for i in range(400)]
    return [(i * 7 % 411, t) for i, t in enumerate(texts)]


def test_edges_and_a_large_group(docs):
    rows = some_rows() + [(1000 + i, "One Very common text") for i in range(300)]
    assert got(docs(rows, 5)) == brute(rows)


@pytest.mark.parametrize("sizes", [{"owner_rows": 8, "step": 2}, {"owner_rows": 1, "step": 8}])
def test_relays_and_fingerprints_that_clash(docs, sizes, monkeypatch):
    """Seven bits for some hundred texts: most fingerprints stand for several; relays pass on in steps."""
    monkeypatch.setattr(copies, "RELAY_ROWS", 64)
    rows = some_rows()
    assert got(docs(rows, 7), bits=7, **sizes) == brute(rows)
    assert got(docs(rows, 7), **sizes) == brute(rows)


def test_relays_send_each_owner_one_message(docs, monkeypatch):
    """Pairs and single texts beside each other in every range: an answer must reach the values it is for."""
    monkeypatch.setattr(copies, "RELAY_ROWS", 64)
    rows = [(i, f"pair {i % 400}" if i < 800 else f"single {i}") for i in range(1600)]
    assert got(docs(rows, 7), owner_rows=8, step=2) == brute(rows)


def test_keys_that_do_not_name_rows(docs):
    rows = [(1, "a"), (1, "A"), (None, "a"), (None, "b"), (None, "b"), (5, "c"), (5, "d"), (-2, "D"), (9, None), (3, "")]
    assert got(docs(rows)) == brute(rows)


def test_marks_in_blocks(spark, docs, monkeypatch):
    """More marks than one job hands out: the files are read in several blocks, each row in one."""
    monkeypatch.setattr(copies, "MARK_BYTES", 200)
    rows = some_rows()
    assert got(docs(rows, 6)) == brute(rows)


def test_table_empty_table_and_other_columns(docs, sf_docs):
    want = brute([(r.doc_id, r.text) for r in sf_docs.collect()])
    assert got(sf_docs, stored=True) == want == got(sf_docs)
    assert copies.exact_copies(docs(["x"]).limit(0)).count() == 0
    clash = docs(["a", "A", "b"]).selectExpr("doc_id", "text", "1 as file", "2 as row", "3 as norm", "4 as n", "5 as keep_id", "6 as part")
    assert got(clash) == brute([(0, "a"), (1, "A"), (2, "b")])
    assert {r.doc_id for r in copies.one_of_each(clash).collect()} == {1, 2}
