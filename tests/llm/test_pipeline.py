import hashlib
import os
import sys

import public_tokenizers
import tiktoken

sys.path.insert(0, os.path.dirname(__file__))

import test_contamination  # noqa: E402
import test_jaccard  # noqa: E402

import corpus_pipeline  # noqa: E402
from caseframe import session  # noqa: E402
from caseframe.llm import bpe, contamination, jaccard, perplexity, secrets, spans  # noqa: E402


def test_run_against_brute_force(spark, sf, sf_docs):
    rows = {r.doc_id: r for r in sf_docs.collect()}
    kept = {r.doc_id for r in perplexity.judged(sf_docs).collect() if r.kept}
    left = [(i, rows[i].text) for i in sorted(kept)]
    firsts = {c for _, _, c in test_jaccard.brute(left)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i in firsts if not test_contamination.brute(rows[i].text, items)[-1]}
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    texts = {i: spans.masked(rows[i].text, secrets.all_spans(rows[i].text)) for i in clean}
    want = {i: (library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}
    assert {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()} == want
    assert len(rows) > len(kept) > len(firsts) > len(clean) > 0


def test_stages_keep_the_columns(spark, sf, sf_docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, sf_docs, sf).schema.names == sf_docs.columns


def test_rows_that_share_a_key(docs, spark):
    frame = docs([(1, "a b c d e f"), (1, "q r"), (None, "a b c d e f"), (2, None), (None, None), (3, "A b c d e f")])
    got = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(frame).collect()), key=repr)
    assert len(got) == 4 and (1, "q r") in got and (2, None) in got and (None, None) in got
    items = spark.createDataFrame([(1, "q r")], "item_id long, text string")
    clean = contamination.clean_documents(frame, items).collect()
    assert len(clean) == 5 and "q r" not in [r.text for r in clean]
    assert perplexity.kept_documents(frame).count() == 0


def test_empty_table(docs, spark, sf):
    empty = docs(["x"]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_batches_of_pieces_are_small(spark, sf, sf_docs):
    """The pieces of 20 MB of text were one batch of 55 MB, held by the executor and by the worker."""
    dict(corpus_pipeline.STAGES)["byte-level BPE"](spark, sf_docs, sf)
    assert spark.conf.get(session.BATCH) == bpe.BATCH == "6m"
    dict(corpus_pipeline.STAGES)["secret scans"](spark, sf_docs, sf)
    assert spark.conf.get(session.BATCH) == session.PINNED[session.BATCH]
