import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from caseframe.llm import contamination as C

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
ITEMS = [(1, LONG), (2, "short item"), (3, None), (4, ""), (5, LONG), (10, "the"), (None, "short item"), (7, "naïve東 x 9"), (8, "a a a")]
TEXTS = [
    None, "", "--- ...", "nothing here", "Short-ITEM", "short, item! short item", "x " * 10 + LONG.upper() + " tail" * 200,
    " ".join(LONG.split()[2:16]), " ".join(LONG.split()[:12]), "the cat", "cat THE the tHe", "a a a a b a a", "naïve東 X 9", "short item",
    "the " * 3000, "item short",
]


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = split(text), set(), set()
    for key, item in items:
        iw = split(item)
        for s in range(max(len(iw) - 12, 1) if iw else 0):
            win = iw[s : s + 13]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found |= {str(key)} if key is not None else set()
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_against_brute_force(docs, items):
    got = {r.doc_id: tuple(r)[1:] for r in C.contamination(docs(TEXTS), items).collect()}
    assert got == {i: brute(t, ITEMS) for i, t in enumerate(TEXTS)}


def test_shared_and_missing_keys(docs, items):
    rows = [(1, "the cat"), (1, "dog"), (None, "short item"), (None, None), (2, "dog"), (2, "dog")]
    got = sorted((tuple(r) for r in C.contamination(docs(rows), items).collect()), key=repr)
    assert got == sorted(((k, *brute(t, ITEMS)) for k, t in rows), key=repr)


def test_empty_tables(docs, items):
    assert C.contamination(docs(["x"]).limit(0), items).count() == 0
    got = C.contamination(docs(["the x"]), items.limit(0)).first()
    assert tuple(got)[1:] == brute("the x", [])


def test_clashing_columns(docs, items):
    frame = docs(TEXTS).selectExpr("doc_id", "text", "1 as n_words", "2 as win", "3 as word", "4 as start", "5 as of")
    assert C.contamination(frame, items).count() == len(TEXTS)


def test_oracle_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(C.ORACLE_SQL).fetchall()
    got = C.contamination(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r.contaminated for r in got)


def test_no_python_in_the_plan(docs, items):
    plan = C.contamination(docs(TEXTS), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_words_are_what_stands_between_separators(docs):
    """Extracting each match took most of the time; leading, trailing and missing separators must not leave empty words."""
    texts = [*TEXTS, " a", "a ", "\0a\x7f\x80b", "東 京\n\n1", "\U0001f600a\U0001f600 -", "\r\n", "{x}~`Z[", "İı ſ É"]
    frame = docs(texts).select("doc_id", C.words(F.col("text")).alias("w"))
    assert {r.doc_id: r.w for r in frame.collect()} == {i: None if t is None else split(t) for i, t in enumerate(texts)}
    assert "regexp_extract_all" not in frame._jdf.queryExecution().toString()
