import hashlib
import os
import subprocess
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from caseframe.llm import bpe, textops

TEXTS = [
    None, "", " ", "\n\n \t x", "I'm we'll IT'S", "a" * 3000, "ab" * 700, "naïve — übergroß 東京 \U0001f600  x  y   ",
    "x1234567 99", "<|endoftext|>", "tail   ", "tail   \n", "\u0085a\x1cb\x1f c", "ꟊ \U0001fadd 𞤀", "repeat", "repeat",
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())


def test_edge_texts(docs, vocabulary, library):
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(docs(TEXTS), vocabulary, public_tokenizers.PATTERN).collect()}
    assert got == {i: expected(library, t) for i, t in enumerate(TEXTS)}


def test_whole_table(sf_docs, vocabulary, library):
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(sf_docs, vocabulary, public_tokenizers.PATTERN).collect()}
    assert got == {r.doc_id: expected(library, r.text) for r in sf_docs.collect()}


def test_round_trip_keeps_columns(docs, vocabulary, library):
    df = docs(TEXTS).withColumnRenamed("source", "decoded")
    back = bpe.decode(bpe.encode(df, vocabulary, public_tokenizers.PATTERN), vocabulary)
    assert sorted(back.columns) == sorted(["doc_id", "text", "lang", "decoded", "n_chars", "ids"])
    for r in back.collect():
        assert bytes(r.decoded).decode() == (r.text or "")
        assert r.ids == library.encode_ordinary(r.text or "")


def test_empty_table(docs, vocabulary):
    assert bpe.digests(docs(["x"]).limit(0), vocabulary, public_tokenizers.PATTERN).count() == 0

def test_memory_is_bounded_by_the_query():
    """2000 distinct pieces of 250 letters need some 170 rounds each; only the last one is kept."""
    code = """
import random, resource
import public_tokenizers
from caseframe.llm import bpe
vocabulary = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
rng = random.Random(1)
pieces = [bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(250)) for _ in range(2000)]
pieces += [bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(40000)]
encoder = bpe.Encoder(vocabulary.tokens, public_tokenizers.PATTERN)
ids, decoded = encoder.lookup(pieces)
assert decoded == pieces
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) < 500


def test_remembered_pieces_stay_within_their_bytes():
    """Two generations of pieces that are met once each: together no more than 64 MB, as a worker counts them."""
    encoder = bpe.Encoder([bytes([b]) for b in range(256)], "")
    for k in range(40):
        encoder.remember({b"%d:%d" % (k, i): (bytes(20), b"") for i in range(20_000)})
    held = sum(bpe.ENTRY_BYTES + len(p) + len(entry[0]) for known in (encoder.known, encoder.older) for p, entry in known.items())
    assert held <= (64 << 20) + 20_000 * (bpe.ENTRY_BYTES + 30) and bpe.SLICE_BYTES <= 4 << 20


def test_workers_get_pieces_without_the_text(docs, vocabulary, library):
    """What is not kept is not sent: a batch of a slice is the pieces, their offsets and a size for each row."""
    made = bpe.encode(docs(TEXTS), vocabulary, public_tokenizers.PATTERN, decoded_sha256="sha", keep=["doc_id"])
    assert made.columns == ["doc_id", "ids", "sha"]
    assert {r.doc_id: r.ids for r in made.collect()} == {i: library.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_slices_by_sizes():
    batch = pa.RecordBatch.from_arrays([pa.array([3, None, 3, 9, 1], pa.int32())], ["size"])
    assert [s.num_rows for s in textops.slices(batch, "size", 6)] == [3, 1, 1]
