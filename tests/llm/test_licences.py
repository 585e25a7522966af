import re
import textwrap

import numpy as np
import pytest

from caseframe.llm import licences as L
from caseframe.llm.licence_texts import BODIES

STATED = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache",
    "All rights reserved.": "reserved",
}


def brute(text):
    """Families of the lines that state a licence in one of the known ways."""
    return ",".join(sorted({STATED[line] for line in (text or "").split("\n") if line in STATED}))


def test_table_against_known_statements(sf_docs):
    rows = {r.doc_id: r for r in L.digests(sf_docs).collect()}
    texts = {r.doc_id: r.text for r in sf_docs.collect()}
    assert set(rows) == set(texts)
    wrong = [i for i, r in rows.items() if r.families != brute(texts[i])]
    assert sum(bool(brute(t)) for t in texts.values()) >= 3 and len(wrong) <= len(rows) // 100, [(rows[i].spans, brute(texts[i])) for i in wrong]


def test_spans_unknown_licences_and_long_lines(docs):
    filler = "é this is a line of plain words about nothing at all"
    long = " ".join(["word"] * 90 + ["Released under the MIT License"] + ["word"] * 90)
    texts = [
        f"{filler}\nReleased under the MIT License.\n{filler}", "Released under the Frobnicate Public License", long, None, "", "\n\n", filler,
        "Released under the MIT License.\nx\nLicensed under the Apache License, Version 2.0.", "w " * 40_000,
    ]
    rows = {r.doc_id: r for r in L.digests(docs(texts * 1 + [filler] * 20)).collect()}
    ((kind, a, b),) = [s.split(":") for s in rows[0].spans.split(",")]
    assert kind == "mit" and texts[0][int(a) : int(b)] == "Released under the MIT License"
    assert rows[1].families == "unknown" and rows[1].n_unknown == 1
    assert rows[2].families == "mit" and rows[2].n_licences == 1
    assert [rows[i].families for i in (3, 4, 5, 6, 8)] == [""] * 5 and rows[3].n_paragraphs == 0
    assert rows[7].families == "apache,mit" and rows[7].n_paragraphs == 3


@pytest.fixture(scope="module")
def model():
    return L.fit(["some plain words that say nothing of note " * 3, "the result was good and we went home"] * 20)


def test_held_back_statements(model):
    made = [x for x in L.examples(["other plain words for a test of it"] * 50, seed=77) if x[1] > 1]
    right = 0
    for s, c in made:
        raw = np.frombuffer(s.encode(), np.uint8)
        bucket, unit, row, left, right_end = L.features(raw, np.array([0, len(raw)]))
        chances = model.chances(bucket, unit, len(row))
        right += L.CLASSES[c] in {f for *_, f in L.found(s, raw, list(zip(left, right_end, chances)))}
    assert right >= 0.95 * len(made)


def test_template_comparison_rules_out_other_families(model):
    stated = "Licensed under the Apache License, Version 2.0."
    assert L.confirmed(stated, "apache") and not L.confirmed(stated, "mit")
    assert not L.confirmed(f"a\n{stated}", "apache") and L.confirmed("the Apache\nLicense", "apache")
    chances = np.zeros(len(L.CLASSES))
    chances[L.CLASSES.index("mit")] = 0.8
    chances[L.CLASSES.index("apache")] = 0.2
    assert L.decide(chances, "Licensed under the Apache License") == "apache"
    chances[L.CLASSES.index("mit")], chances[L.CLASSES.index("apache")] = 1, 0
    assert L.decide(chances, "Licensed under the Apache License") == "unknown"
    assert L.decide(chances, "Licensed under nothing known") == "unknown"
    assert L.decide(chances, "plain words") is None


def wrapped(text, width=60):
    return "\n".join(textwrap.wrap(text, width))


def slow_found(text, model):
    """The same decisions with loops over lines and words."""
    out = []
    for block in re.finditer(r"(?:[^\n]*\S[^\n]*(?:\n|\Z))+", text):
        words = [(block.start() + m.start(), block.start() + m.end()) for m in re.finditer(r"(?:[A-Za-z0-9-]|[^\x00-\x7f])+", block.group())]
        lines = {}
        for w in words:
            lines.setdefault(text.count("\n", 0, w[0]), []).append(w)
        runs = [r for line in lines.values() for r in windows(line)]
        runs += [r for r in windows(words) if "\n" in text[r[0][0] : r[-1][1]]]
        for run in runs:
            piece = text[run[0][0] : run[-1][1]]
            raw = np.frombuffer(piece.replace("\n", " ").encode(), np.uint8)
            bucket, unit, row, _, _ = L.features(raw, np.array([0, len(raw)]))
            family = L.decide(model.chances(bucket, unit, len(row))[0], piece)
            if family:
                out.append((run[0][0], run[-1][1], family))
    named = [s for s in out if s[2] != "unknown"]
    out = {s for s in out if s[2] != "unknown" or not any(s[0] < t[1] and t[0] < s[1] for t in named)}
    places = {k: sorted({i for a, b, f in out if f == k for i in range(a, b)}) for k in {s[2] for s in out}}
    long = []
    for k, at in places.items():
        for i in at:
            if long and long[-1][2] == k and long[-1][1] == i:
                long[-1] = (long[-1][0], i + 1, k)
            else:
                long.append((i, i + 1, k))
    return {s for s in long if not any(t[2] != s[2] and t[0] <= s[0] and s[1] <= t[1] and t[1] - t[0] > s[1] - s[0] for t in long)}


def windows(words):
    step, n = L.UNIT_WORDS // 2, max(1, -(-(len(words) - L.UNIT_WORDS) // (L.UNIT_WORDS // 2)) + 1)
    return [words[k * step : k * step + L.UNIT_WORDS] for k in range(n)]


def test_found_against_loops(model):
    texts = [
        wrapped("plain words here. " * 30 + BODIES["isc"][0] + " and then more plain words " * 20), "é " * 40 + "\nReleased under the MIT\nLicense. é",
        "a\n\nLicensed under the Frob\nnicate license\n \nb c", wrapped(BODIES["bsd"][0], 33) + "\n\n" + wrapped(BODIES["mit"][0]),
    ]
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        bucket, unit, row, left, right = L.features(raw, np.array([0, len(raw)]))
        got = L.found(text, raw, list(zip(left.tolist(), right.tolist(), model.chances(bucket, unit, len(row)))))
        covered = {(k, i) for a, b, k in got for i in range(a, b)}
        assert covered == {(k, i) for a, b, k in slow_found(text, model) for i in range(a, b)}


@pytest.mark.parametrize("family", ["mit", "bsd", "isc", "apache", "gpl", "lgpl", "mpl", "unlicense"])
def test_bodies_and_wrapped_headers(docs, family):
    filler = "this is a paragraph of plain words about nothing at all and then some"
    texts = [f"{filler}\n\n{wrapped(body, width)}\n\n{filler}" for body in BODIES[family] for width in (50, 76, 10_000)]
    rows = L.digests(docs(texts + [filler] * 20)).collect()
    for r in rows:
        assert r.families == (family if r.doc_id < len(texts) else ""), (r.doc_id, r.spans)
        if r.doc_id < len(texts):
            a, b = min(int(s.split(":")[1]) for s in r.spans.split(",")), max(int(s.split(":")[2]) for s in r.spans.split(","))
            body = len(texts[r.doc_id]) - 2 * len(filler) - 4
            assert len(filler) + 2 <= a and b <= len(texts[r.doc_id]) - len(filler) - 2 and b - a >= 0.8 * body


def test_a_name_over_a_line_end(docs):
    rows = {r.doc_id: r.families for r in L.digests(docs(["This program is covered by the GNU General Public\nLicense.", "the GNU General Public\n\nmatter"])).collect()}
    assert rows[0] == "gpl" and "gpl" not in rows[1]


def test_units_cover_all_words():
    text = " ".join(f"w{i}" for i in range(101)) + "\n\na b\n"
    raw = np.frombuffer(text.encode(), np.uint8)
    *_, row, left, right = L.features(raw, np.array([0, len(raw)]))
    covered = set()
    for a, b in zip(left, right):
        covered |= set(re.findall(r"\w+", text[a:b]))
    assert covered == set(re.findall(r"\w+", text)) and len(row) == 7 and set(row) == {0}


def test_empty_table_and_clashing_columns(docs):
    assert L.digests(docs(["x"]).limit(0)).count() == 0
    odd = docs([(None, "Released under the MIT License."), (1, "a")]).selectExpr("doc_id", "text", "1 as key", "2 as licences", "3 as spans")
    assert {r.doc_id: r.families for r in L.digests(odd).collect()} == {None: "mit", 1: ""}
