import random

import numpy as np
import re

import pytest

from caseframe.llm import jaccard
from caseframe.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    """(key, n, component) of every row; rows of one key are linked only by their texts."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, len(s), least.get(find(i))) for i, ((key, _), s) in enumerate(zip(rows, sets))), key=repr)


def got(df):
    return sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=repr)


def near_copies(seed, n_groups=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "On", "re", "é", "東", "!"]) for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(n_groups):
        base = [word() for _ in range(rng.choice([3, 6, 30, 120, 400]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 2)] = [word()]
            rows.append(rng.choice([" ", "\n", " \t "]).join(copy).swapcase() if rng.random() < 0.3 else " ".join(copy))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_near_copies(docs, seed):
    rows = list(enumerate(near_copies(seed)))
    assert got(docs(rows)) == brute(rows)


def test_chains_ties_and_edges(docs):
    base = [f"w{i}" for i in range(60)]
    chain = [" ".join(base[k : k + 45]) for k in range(0, 15, 2)]
    texts = [None, "", " \n", "a", "A", "a b c d", "a b c d", "a b c d e", "b a", "x" * 100_000, *chain, "x" * 100_000, "\x0bA\u0085 b"]
    rows = list(enumerate(texts))
    assert got(docs(rows)) == brute(rows)


def test_large_group_of_near_copies_and_a_common_passage(docs):
    rng = random.Random(5)
    base, passage = [f"w{i}" for i in range(80)], [f"p{i}" for i in range(50)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(80)] = f"x{i}{rng.random()}"
        rows.append(" ".join(copy))
        rows.append(" ".join(passage + [f"y{i}.{k}" for k in range(rng.randint(5, 14))]))
    rows = [(1000 - i, t) for i, t in enumerate(rows)]
    assert got(docs(rows)) == brute(rows)


def test_keys_that_do_not_name_rows(docs):
    rows = [(1, "a b c d e f"), (1, "q"), (None, "a b c d e f"), (None, None), (7, "q"), (7, "q"), (-3, "A B C D E F")]
    assert got(docs(rows)) == brute(rows)


def test_table_empty_table_and_other_columns(docs, sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    assert got(sf_docs) == brute(rows)
    assert jaccard.near_duplicates(docs(["x"]).limit(0)).count() == 0
    frame = docs(["a b", "a b"]).selectExpr("doc_id", "text", "1 as id", "2 as n", "3 as label", "4 as k1", "5 as component_id")
    assert got(frame) == [(0, 1, 0), (1, 1, 0)]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200 + i) for i in range(40)] + [(500, 500), (90, 95), (95, 90)]
    found = {r.id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(31)} | {i: 100 for i in [100, *range(200, 240)]} | {90: 90, 95: 90}


def test_hot_shingles_are_not_gathered(docs):
    rows = list(enumerate(near_copies(9, n_groups=6) + ["the same five words here again"] * 9 + ["the same five words here again now"] * 9))
    want = brute(rows)
    frame = docs(rows)
    tokens, _ = jaccard.hot_tokens(frame.selectExpr("doc_id as id", "text"), len(rows), least=2)
    found = jaccard.near_duplicates(frame, hot_least=2).collect()
    assert len(tokens) and sorted(map(tuple, found), key=repr) == want


def test_hashes_are_compared_whole():
    """Shingles that agree in their first 48 bits only are different, within a document and between two."""
    import pyarrow as pa

    rng = random.Random(1)
    values = np.sort(np.array([rng.getrandbits(48) << 16 for _ in range(100)], np.uint64))
    near = values.copy()
    near[:15] += np.uint64(1)  # 85 shared, 15 that clash in 48 bits: 100 * 85 < 80 * 115
    twice = np.sort(np.concatenate((values[:89], values[:2] + np.uint64(7), values[89:98])))  # 2 clash within the document
    for other, links in ((near, False), (twice, True)):
        shared = len(set(values.tolist()) & set(other.tolist()))
        assert (100 * shared >= 80 * (200 - shared)) == links
        bitmap = np.full(jaccard.BITMAP_BITS // 64, -1, np.int64).tolist()
        row = {"a": [1], "b": [2], "a_n": [100], "b_n": [100], "a_bitmap": [bitmap], "b_bitmap": [bitmap], "a_tokens": [values.tobytes()], "b_tokens": [other.tobytes()]}
        batch = pa.RecordBatch.from_pydict(row)
        assert sum(b.num_rows for b in jaccard._compare(iter([batch]))) == links


def test_tokens_keep_all_bits(docs):
    import pyarrow as pa

    texts = ["a b c d e f g h", "x y z", "a b c d e q r s"]
    raw, offsets = jaccard.textops.text_buffer(pa.array(texts))
    want = np.sort(jaccard.shingle_sets(raw, offsets)[0])
    token, _ = jaccard._slice_tokens(pa.RecordBatch.from_pydict({"text": texts, "id": [1, 2, 3]}))
    assert (token == want).all() and (token & np.uint64(0xFFFF)).any()
