"""Byte search against Python's own find and finditer."""

import random
import re

import pytest

from caseframe import schemas
from caseframe.functions import scan
from caseframe.operators import chunk_regex, quality, search, term_table

OBJ = "file_id long, content binary"


def find_all(data, term):
    out, at = [], data.find(term)
    while at != -1:
        out.append(at)
        at = data.find(term, at + 1)
    return out


def blobs(seed, n=12, alphabet=b"ab.\n\xe9\xff "):
    rng = random.Random(seed)
    out = [bytes(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 300, 2000]))) for _ in range(n)]
    return out + [b"aaaa", b"a" * 500]


def frame(spark, data):
    return spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], OBJ)


def test_literal_offsets_including_overlaps(spark):
    data = blobs(1)
    terms = [b"aa", b"ab", b".", b"\xe9\xff", b"a.b", b"aba", b"\n", b"zzz"]
    hits = search.search_objects(frame(spark, data), [(t, "literal") for t in terms])
    assert quality.schema_drift(hits, schemas.SEARCH_HITS) == []
    got = sorted((r.file_id, r.term.encode("latin-1"), r.byte_offset) for r in hits.collect())
    want = sorted((i, t, o) for i, d in enumerate(data) for t in terms for o in find_all(d, t))
    assert got == want


@pytest.mark.parametrize("pattern", [r"a+", r"a.b", r"[^a]b", r"\d+|a", r"(?:ab){2}", r"a*", r"\ba", r"(?P<x>a)b", r"\xff+", r"a$"])
def test_regex_spans(spark, pattern):
    data = blobs(2)
    hits = search.search_objects(frame(spark, data), regexes=[pattern])
    got = sorted((r.file_id, r.byte_offset, r.term.encode("latin-1")) for r in hits.collect())
    rx = re.compile(pattern.encode("latin-1"))
    want = sorted((i, m.start(), m.group(0)) for i, d in enumerate(data) for m in rx.finditer(d) if m.end() > 0)
    assert got == want


def test_long_match_is_cut_and_tells_its_length(spark):
    got = search.search_objects(frame(spark, [b"x" + b"a" * 9000 + b"y"]), regexes=["a+"]).collect()
    assert [(r.byte_offset, len(r.term), r.attributes) for r in got] == [(1, 4096, '{"match_length":9000}')]


def test_case_insensitive_and_empty_matches(spark):
    hits = search.search_objects(frame(spark, [b"EVIL.com evil.com Evil"]), regexes=["(?i)evil"])
    assert sorted(r.term for r in hits.collect()) == ["EVIL", "Evil", "evil"]
    ahead = search.search_objects(frame(spark, [b"abxab"]), regexes=["(?=ab)"])
    assert [r.byte_offset for r in ahead.collect()] == [3]


def test_context_is_bounded(spark):
    data = bytes(range(256))
    row = search.search_objects(frame(spark, [data]), [(b"\x64\x65", "ioc")]).first()
    assert row.context == data[0x64 - 32 : 0x66 + 32].decode("latin-1") and row.term_kind == "ioc"
    near = search.search_objects(frame(spark, [b"abXcd"]), [(b"X", "literal")]).first()
    assert near.context == "abXcd"


@pytest.mark.parametrize("pattern", ["(a+)+", "(.*)*x", "(a|b)*", "(a{2,})+", "[", "(unclosed", "((a+)b?)*c", "(a+){2,}", r"(\w+\s?){5,}$"])
def test_unsafe_or_invalid_patterns_are_refused(pattern):
    with pytest.raises(scan.PatternError):
        scan.check_pattern(pattern)


def cut(spark, data, size, base0=0):
    rows = [(i, base0 + o, bytearray(d[o : o + size])) for i, d in enumerate(data) for o in range(0, len(d), size)]
    return spark.createDataFrame(rows, "object_id long, base long, data binary")


@pytest.mark.parametrize("size, window", [(7, 64), (16, 200), (100, 128), (1000, 64)])
def test_chunks_equal_whole_objects(spark, size, window):
    data = blobs(3)
    terms = [(b"aa", "literal"), (b"ab.", "ioc"), (b"\xff\xe9", "literal")]
    hits = search.search_chunks(cut(spark, data, size), ["object_id"], terms, window=window)
    got = sorted((r.object_id, r.term.encode("latin-1"), r.term_kind, r.byte_offset, r.context) for r in hits.collect())
    want = sorted(
        (i, t, k, o, d[max(0, o - 32) : o + len(t) + 32].decode("latin-1"))
        for i, d in enumerate(data) for t, k in terms for o in find_all(d, t)
    )
    assert got == want


def test_chunked_regex_equals_whole_objects(spark):
    rng = random.Random(5)
    data = [bytes(rng.choice(b"abc ") for _ in range(60000)), b"a" * 30000, b"b" * 9000 + b"a" * 100 + b"b"]
    pattern = r"a+b"
    hits = search.search_chunks(cut(spark, data, 512), ["object_id"], regexes=[pattern], window=9000)
    got = sorted((r.object_id, r.byte_offset, r.term) for r in hits.collect())
    want = sorted((i, m.start(), m.group(0)[:4096].decode()) for i, d in enumerate(data) for m in re.finditer(pattern.encode(), d))
    assert got == want


@pytest.mark.parametrize("pattern", [r"\d{1,3}(?:\.\d{1,3}){3}", r"[a-z]{7}", r"ab?", r"a*", r"(?i)AB+", r"(?<=a)b"])
def test_dense_matches_do_not_depend_on_windows(spark, pattern):
    rng = random.Random(11)
    data = [b"1.22.333.4" * 900, b"abcdefghijk" * 1500, bytes(rng.choice(b"ab1.") for _ in range(30000)), b"a" * 100]
    hits = search.search_chunks(cut(spark, data, 700), ["object_id"], regexes=[pattern], window=8300)
    got = sorted((r.object_id, r.byte_offset, r.term) for r in hits.collect())
    want = sorted((i, m.start(), m.group(0).decode()) for i, d in enumerate(data) for m in re.finditer(pattern.encode(), d) if m.end())
    assert got == want


def test_term_at_a_chunk_edge_once(spark):
    data = b"." * 12 + b"NEEDLE42" + b"." * 20
    hits = search.search_chunks(cut(spark, [data], 16), ["object_id"], [(b"NEEDLE42", "literal")])
    assert [r.byte_offset for r in hits.collect()] == [12]


def test_no_match_across_a_gap_and_block_numbers(spark):
    image = b"....NEED" + b"LEneedle" + b"NEED...." + b"LE.NEEDLE."[:8] + b"DLE....."
    rows = [(0, 4096, i, bytearray(image[i * 8 : i * 8 + 8])) for i in (0, 2, 3, 4)]
    blocks = spark.createDataFrame(rows, "volume_id long, volume_offset long, block_index long, data binary")
    hits = search.search_blocks(blocks, 8, [(b"NEEDLE", "literal"), (b"NEED", "literal")])
    assert quality.schema_drift(hits, schemas.SEARCH_HITS) == []
    got = sorted((r.term, r.byte_offset - 4096, r.block_index, r.region) for r in hits.collect())
    assert got == [("NEED", 4, 0, "unallocated"), ("NEED", 16, 2, "unallocated"), ("NEED", 27, 3, "unallocated")]


@pytest.mark.parametrize("shard_bytes", [400, 1 << 20])
def test_long_term_lists(spark, shard_bytes):
    rng = random.Random(9)
    data = [bytes(rng.choice(b"abcd") for _ in range(400)) for _ in range(10)] + [b"", b"ab"]
    terms = list({bytes(rng.choice(b"abcd") for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 12]))) for _ in range(120)})
    terms += [data[0][50:70], data[1][0:30]]
    table = spark.createDataFrame([(bytearray(t), "ioc") for t in terms], "term binary, kind string")
    hits = term_table.table_hits(frame(spark, data), table, shard_bytes=shard_bytes)
    got = sorted((r.file_id, r.term.encode("latin-1"), r.offset, r.context) for r in hits.collect())
    want = sorted(
        (i, t, o, d[max(0, o - 32) : o + len(t) + 32].decode("latin-1"))
        for i, d in enumerate(data) for t in set(terms) for o in find_all(d, t)
    )
    assert got == want
    if shard_bytes > 400:
        few = [(t, "ioc") for t in terms[: search.MAX_PLAN_TERMS]]
        for listed in (few, [(t, "ioc") for t in terms]):
            hits = search.search_objects(frame(spark, data).drop("file_id"), listed)
            assert hits.count() == sum(len(find_all(d, t)) for d in data for t, _ in set(listed))


def test_long_lists_over_chunks(spark):
    data = blobs(4)
    terms = [(bytes([a, b]), "ioc") for a in b"ab.\n\xe9" for b in b"ab.\n\xff "] + [(bytes([97, b, c]), "ioc") for b in b"ab. \n\xe9" for c in b"ab. \n\xff\xe9"]
    assert len(terms) > search.MAX_PLAN_TERMS
    chunks = cut(spark, data, 50).withColumnRenamed("object_id", "file_id")
    hits = search.search_file_chunks(chunks, terms, window=256)
    assert quality.schema_drift(hits, schemas.SEARCH_HITS) == []
    got = sorted((r.file_id, r.term.encode("latin-1"), r.byte_offset, r.region) for r in hits.collect())
    assert got == sorted((i, t, o, "allocated") for i, d in enumerate(data) for t, _ in terms for o in find_all(d, t))


def test_searchable_scope(spark):
    rows = [(1, "reg", True, 1, bytearray(b"x")), (2, "dir", True, 1, bytearray(b"x")), (3, "reg", None, 1, bytearray(b"x")), (4, "reg", False, 1, bytearray(b"x")), (5, "reg", True, 0, bytearray(b""))]
    df = spark.createDataFrame(rows, "file_id long, meta_type string, allocated boolean, size long, content binary")
    assert [r.file_id for r in search.searchable(df).collect()] == [1]


def test_terms_of_every_length_and_kind(spark):
    rng = random.Random(4)
    data = [bytes(rng.randrange(256) for _ in range(3000)) for _ in range(3)] + [b"\0" * 40, b"abcabcabc" * 300, None, b""]
    terms = [d[k : k + n] for d in data[:2] for n in range(1, 60) for k in (0, 700, len(d) - n)] + [b"\0" * n for n in (1, 7, 8, 9, 40, 41)]
    terms += [b"abc" * n for n in (1, 2, 5, 200)] + [b"x" * 5000, b"abcabcabd"]
    rows = [(bytearray(t), kind) for t in dict.fromkeys(terms) for kind in ("ioc", "literal")]
    table = spark.createDataFrame([*rows, *rows[:5], (bytearray(b""), "ioc"), (None, "ioc")], "term binary, kind string")
    objects = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(data)], OBJ)
    got = sorted((r.file_id, r.term.encode("latin-1"), r.term_kind, r.byte_offset) for r in search.search_term_table(objects, table).collect())
    want = sorted((i, t, k, o) for i, d in enumerate(data) if d for t in set(terms) for k in ("ioc", "literal") for o in find_all(d, t))
    assert got == want
    assert search.search_term_table(objects, table.limit(0)).count() == 0
    assert all(r.context is None for r in search.search_term_table(objects, table, context=False).take(3))


@pytest.mark.parametrize("levels, stretch", [(0, 256), (1, 3), (2, 2), (3, 2)])
def test_patterns_over_many_windows_in_stretches(spark, levels, stretch):
    """The same hits however the windows are grouped; a group is never larger than a stretch, but for the top."""
    rng = random.Random(21)
    size, text = 8300, bytes(rng.choice(b"ab") for _ in range(40000)) + b"\n" + b"a" * 60001
    data = [text, b"ab" * 30000, b"abc\n" * 9000]
    windows = search.cut_windows(cut(spark, data, 900), ["object_id"], search.margin_for((), ["x"]), size)
    for pattern in (r"[^\n]{7}", r"ab?a{1,3}", r"(?s).{4096}"):
        hits = chunk_regex.regex_hits(windows, pattern, size, levels, stretch)
        got = sorted((r.object_id, r.base + r.offset, r.span) for r in hits.collect())
        rx = re.compile(pattern.encode())
        assert got == [(i, m.start(), len(m.group())) for i, d in enumerate(data) for m in rx.finditer(d)]


def test_composed_maps_follow_like_their_windows():
    rng = random.Random(2)
    for _ in range(40):
        text = bytes(rng.choice(b"ab\n") for _ in range(60))
        rx = re.compile(rng.choice([rb"[^\n]{3}", rb"ab+", rb"a|bb", rb"a*"]))
        maps, edges = [], list(range(0, 61, 6))
        for lo, hi in zip(edges[:-1], edges[1:]):
            steps = chunk_regex.exits(rx, text, lo, hi)
            maps.append(tuple(chunk_regex.np.array(x) for x in zip(*steps)))
        uptos, leaves = chunk_regex.compose(maps, 0)
        for enter in range(6):
            place = enter
            for u, v in maps:
                place = int(chunk_regex._left(u, v, place))
            assert int(chunk_regex._left(uptos, leaves, enter)) == place


@pytest.mark.parametrize(
    "pattern, reach",
    [(r"[^\n]{5}", 5), (r"ab?a{1,3}", 5), (r"a|bcd", 3), (r"a*", 4096), (r"(?s).{9000}", 4096), (r"\bab", 4096), (r"a(?=b)", 4096), (r"(?:(?:ab$)c)", 4096), (r"(a{3})\1", 6), (r"", 1)],
)
def test_reach_of_patterns(pattern, reach):
    assert scan.reach(pattern) == reach


def test_maps_of_windows_are_as_small_as_the_matches():
    """A map has a step for each place where a scan can enter, and one for all that leave at the same place."""
    dense, line = re.compile(rb"[^\n]{5}"), re.compile(rb"[^\n]+b")
    assert len(chunk_regex.exits(dense, b"a" * 20000, 100, 8300, scan.reach(r"[^\n]{5}"))) <= 7
    assert len(chunk_regex.exits(dense, (b"a" * 60 + b"\n") * 300, 100, 8300)) <= 70
    assert len(chunk_regex.exits(line, b"a" * 8298 + b"bbbb", 100, 8300)) <= 2


def test_matches_leave_python_in_slices():
    """Many windows of one batch: what is held follows the bytes of a slice, not of the batch."""
    pa = chunk_regex.pa
    data = pa.array([b"x" * 4096] * 1500 + [b""] + [b"y" * (3 << 20)], pa.binary())
    ones = chunk_regex.np.ones
    parts = list(chunk_regex._sliced((data,), lambda d: (ones(len(d) // 5, "int64"), ones(len(d) // 5, "int64"))))
    assert sum(len(ends) - 1 for ends, _, _ in parts) == len(data)
    assert max(len(a) for _, a, _ in parts) <= (4 << 20) // 5 and len(parts) >= 6
