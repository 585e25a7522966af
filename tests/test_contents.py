"""Contents in pieces: digests in order, and deleted files put together from blocks."""

import hashlib
import random

import pytest

from caseframe.operators import contents

KEYS = ["a", "b"]


def digests(data):
    return tuple(hashlib.new(x, data).hexdigest() for x in ("md5", "sha1", "sha256"))


def found(df):
    return {(r.a, r.b): (r.read_length, r.md5, r.sha1, r.sha256, r.hash_skipped) for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_digests_of_pieces(spark, partitions):
    rng = random.Random(1)
    data = {(i, f"n{i % 3}"): rng.randbytes(rng.choice([1, 10, 999, 5000])) for i in range(40)}
    data[None, None] = b"null keys"
    rows = [(a, b, k, bytearray(d[k : k + 64])) for (a, b), d in data.items() for k in range(0, len(d), 64)]
    rows += [(1, "n1", 0, bytearray(data[1, "n1"][:100]))]  # overlaps
    rng.shuffle(rows)
    sizes = [(a, b, len(d)) for (a, b), d in data.items()] + [(100, "x", 0), (101, "x", 5)]
    chunks = spark.createDataFrame(rows, "a long, b string, base long, data binary").repartition(partitions)
    got = found(contents.chunk_digests(chunks, spark.createDataFrame(sizes, "a long, b string, size long"), KEYS))
    want = {k: (len(d), *digests(d), None) for k, d in data.items()}
    want |= {(100, "x"): (0, *digests(b""), None), (101, "x"): (0, None, None, None, "short_read")}
    assert got == want


def test_gaps_and_limits(spark):
    rows = [(1, "x", 0, bytearray(b"abcd")), (1, "x", 6, bytearray(b"gh")), (2, "x", 2, bytearray(b"cd")), (3, "x", 0, bytearray(b"abcdef"))]
    chunks = spark.createDataFrame(rows, "a long, b string, base long, data binary")
    sizes = spark.createDataFrame([(1, "x", 8), (2, "x", 4), (3, "x", 6)], "a long, b string, size long")
    all_of = contents.chunk_digests(chunks, sizes, KEYS)
    got = found(all_of)
    assert [got[i, "x"][0] for i in (1, 2, 3)] == [4, 0, 6] and [got[i, "x"][4] for i in (1, 2, 3)] == ["short_read", "short_read", None]
    kept = contents.readable(chunks, all_of, KEYS).collect()
    assert sorted((r.a, bytes(r.data)) for r in kept) == [(1, b"abcd"), (3, b"abcdef")]
    small = found(contents.chunk_digests(chunks, sizes, KEYS, max_hash_size=6))
    assert small[1, "x"] == (0, None, None, None, "exceeds_max_hash_size") and small[3, "x"][3] == digests(b"abcdef")[2]


def test_contents_from_blocks(spark):
    """Runs in file order, holes, a short last block, shared blocks, data in the record, blocks that cannot be read."""
    rng = random.Random(4)
    size, volumes = 16, {0: rng.randbytes(16 * 40 + 5), 1: rng.randbytes(16 * 9)}
    blocks = [(v, k // size, bytearray(d[k : k + size])) for v, d in volumes.items() for k in range(0, len(d), size) if (v, k // size) != (1, 4)]
    inodes, want = [], {}
    for addr in range(30):
        v = addr % 2
        n = len(volumes[v]) // size
        runs = [(None if rng.random() < 0.2 else rng.randrange(n - 3), rng.choice([0, 1, 2, 3])) for _ in range(rng.randint(1, 4))]
        body, lost = b"", None
        for start, length in runs:
            for i in range(length):
                lost = len(body) if start is not None and (v, start + i) == (1, 4) and lost is None else lost
                body += bytes(size) if start is None else volumes[v][(start + i) * size : (start + i + 1) * size]
        want_size = rng.choice([len(body), max(len(body) - 7, 0), len(body) + 9])
        inodes.append((v, addr, want_size, runs, None))
        want[v, addr] = body[:want_size][:lost]
    inodes += [(0, 90, 5, [(40, 1)], None), (0, 91, 3, [(0, 1)], bytearray(b"resident")), (0, 92, 0, [(0, 1)], None), (0, 93, 4, [], None), (0, 94, 9, [(39, 5)], None)]
    want |= {(0, 90): volumes[0][640:645], (0, 91): b"res", (0, 92): b"", (0, 93): b"", (0, 94): volumes[0][624:633]}
    nodes = spark.createDataFrame(inodes, "volume_id long, meta_addr long, size long, runs array<struct<start:long,len:long>>, resident binary")
    grid = spark.createDataFrame(blocks, "volume_id long, block_index long, data binary")
    pieces = contents.recovered_chunks(nodes, grid, size)
    got = {(r.volume_id, r.meta_addr): r for r in contents.chunk_digests(pieces, nodes, contents.INODE).collect()}
    sizes = {(v, a): s for v, a, s, _, _ in inodes}
    assert set(got) == set(want)
    for key, body in want.items():
        assert got[key].read_length == len(body), key
        assert got[key].sha256 == (digests(body)[2] if len(body) == sizes[key] else None), key
