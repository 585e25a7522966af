import zlib

import numpy as np
import pytest

from caseframe.llm import langid

fold = lambda i: zlib.crc32(str(i).encode()) % 5


def test_held_out_accuracy(sf_docs):
    rows = {r.doc_id: r for r in langid.identified(sf_docs).collect()}
    truth = {r.doc_id: r.lang for r in sf_docs.collect()}
    assert set(rows) == set(truth)
    assert all(r.held_out == (fold(i) == 0) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [r.lang_pred == truth[i] for i, r in rows.items() if r.held_out]
    assert len(held) > 20 and np.mean(held) >= 0.9
    assert {r.lang_pred for r in rows.values()} <= set(truth.values())


def test_edge_texts(docs):
    texts = ["the thing and this"] * 30 + [None, "", "123 !!", "é", "x" * 60_000, "\U0001f600 7"]
    rows = {r.doc_id: r for r in langid.identified(docs(texts)).collect()}
    for i, t in enumerate(texts):
        lettered = bool(t) and any(c.isalpha() for c in t)
        assert rows[i].lang_pred == ("en" if lettered else "und") and (lettered or (rows[i].score == 0 and not rows[i].accepted))


def test_labels_of_the_held_out_fold_are_not_learned(spark, docs):
    ids = list(range(200))
    frame = docs([(i, "der und das" if fold(i) == 0 else "the and of") for i in ids])
    frame = frame.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 5 = 0 then 'de' else 'en' end lang", "'x' source")
    got = langid.identified(frame).collect()
    assert {r.lang_pred for r in got} == {"en"}


def test_without_labels_and_without_rows(docs):
    frame = docs(["abc", None]).selectExpr("doc_id", "text", "cast(null as string) lang", "1 as score", "2 as lang_pred")
    assert [(r.lang_pred, r.score) for r in langid.identified(frame).collect()] == [("und", 0.0)] * 2
    assert langid.identified(docs(["abc"]).limit(0)).count() == 0


def test_rows_without_id(docs):
    got = langid.identified(docs([(None, "abc abd"), *[(i, "abc abd") for i in range(9)]])).collect()
    assert len(got) == 10 and all(r.lang_pred == "en" for r in got) and [r.held_out for r in got if r.doc_id is None] == [True]


@pytest.mark.parametrize("text", ["", "a", "ab cd", "é"])
def test_subwords_stay_in_their_rows(text):
    raw = text.encode()
    both = np.frombuffer(raw + raw, np.uint8)
    value, rows = langid.subwords(both, np.array([0, len(raw), 2 * len(raw)]))
    assert value[rows == 0].tolist() == value[rows == 1].tolist()
