import hashlib
import re

from caseframe.llm import disclosure as D

TEXTS = [
    None, "", "plain words", "a@b.c_d@e.f x@y @z.w q@-.-- é.ü@m.n", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111 6011000990139424", "+1 (773) 555-3030. +12 +1234567 +1--------------2",
    "+1 2.3.4.5 4111111111111111", "x" * 60_000 + "@", "1" * 60_000, "a@b.co", "a@b.co", "東京 x@y.zz +49 30 1234567", "@" * 3000 + "a@b.c",
]


def luhn(s):
    ds = [int(c) for c in s][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(ds)) % 10 == 0


def brute(text):
    text, found = text or "", []
    num = lambda s: re.sub("[^0-9]", "", s)
    if len(text) < 20_000:
        found += [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(num(m[0])) <= 19 and luhn(num(m[0]))]
    found += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(num(m[0])) <= 15]
    found.sort()
    line = ",".join(f"{D.KINDS[k]}:{a}:{b}" for k, a, b in found)
    return (*(sum(f[0] == k for f in found) for k in range(4)), hashlib.sha256(line.encode()).hexdigest()), line


def check(rows, texts):
    for r in rows:
        want, line = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want, texts[r.doc_id][:80]
        parts = [s for s in r.spans.split(",") if s and not s.startswith("term:")]
        assert ",".join(parts) == line


def test_base_on_edge_texts(docs):
    rows = D.digests(docs(TEXTS)).collect()
    assert len(rows) == len(TEXTS)
    check(rows, dict(enumerate(TEXTS)))


def test_base_on_a_table(sf_docs):
    check(D.digests(sf_docs).collect(), {r.doc_id: r.text for r in sf_docs.collect()})


def revealing_texts():
    told = [f"who{i} met Zorblax near z@x.org on day dot{i}" for i in range(4)]
    return told + [told[0]] + [f"the note n{i} met day near on" for i in range(40)] + ["Zorblax alone"]


def test_terms_that_reveal(docs):
    texts = revealing_texts()
    rows = {r.doc_id: r for r in D.digests(docs(texts)).collect()}
    for i, t in enumerate(texts):
        terms = [s.split(":") for s in rows[i].spans.split(",") if s.startswith("term:")]
        found = [t[int(a) : int(b)] for _, a, b in terms]
        assert found == (["Zorblax"] if "z@x.org" in t else []), t
        assert rows[i].n_terms == len(found)


def test_copies_count_once(docs):
    texts = ["w met Zorblax near z@x.org"] * 10 + ["other text"] * 50
    assert all(r.n_terms == 0 for r in D.digests(docs(texts)).collect())


def test_sanitised(docs):
    texts = revealing_texts() + [None, "call +1 (773) 555-3030 now"]
    got = {r.doc_id: r.text for r in D.sanitised(docs(texts)).collect()}
    assert got[0] in ("who0 met  near [email] on day dot0", "who0 met [name] near [email] on day dot0")
    assert got[len(texts) - 2] is None and got[len(texts) - 1] == "call [phone] now" and got[7] == texts[7]


def test_rows_without_own_key_and_clashing_columns(docs):
    frame = docs([(1, "a@b.co"), (1, "no"), (None, "1.2.3.4"), (None, None)])
    got = sorted(((r.doc_id, r.spans) for r in D.digests(frame).collect()), key=repr)
    assert got == [(1, ""), (1, "email:0:6"), (None, ""), (None, "ip:0:7")]
    odd = docs(["a@b.co"]).selectExpr("doc_id", "text", "1 as id", "2 as spans", "3 as mentions", "4 as told")
    assert D.digests(odd).first().spans == "email:0:6"
    assert D.digests(docs(["x"]).limit(0)).count() == 0


def test_terms_of_an_entity_in_one_document(docs):
    common = [f"the note n{i} has day near on and so far" for i in range(400)]
    told = "Zorblax near on " + "the note has day " * 5 + "x@y.zz and code QX77Z far"
    copies = [told, told, f"{told} {told}", "call 1.2.3.4 the day near"]
    rows = {r.doc_id: r for r in D.digests(docs(copies + common)).collect()}
    for i, t in enumerate(copies):
        found = [t[int(a) : int(b)] for k, a, b in (s.split(":") for s in rows[i].spans.split(",")) if k == "term"]
        assert set(found) == ({"Zorblax", "QX77Z", "code"} if i < 3 else {"call"}), t
    assert len([s for s in rows[2].spans.split(",") if s.startswith("term")]) == 6
    clean = D.sanitised(docs(copies + common)).where("doc_id = 0").first().text
    assert "Zorblax" not in clean and "QX77Z" not in clean and "[email]" in clean
