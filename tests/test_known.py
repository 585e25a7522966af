"""Hash lists and matching against a nested loop."""

import hashlib
import random

from pyspark.sql import functions as F

from caseframe import schemas
from caseframe.operators import known, quality

M, S1, S2 = (getattr(hashlib, a)(b"x").hexdigest() for a in ("md5", "sha1", "sha256"))


def test_tolerant_list(spark):
    body = ["# comment", "", f"  {M.upper()}  name.txt", M, f"{S1}\tx", S2, "f" * 31 + "g", "abc", f"#{S1}", f"{S1[:-1]}x"]
    df = spark.createDataFrame([(b,) for b in body], "value string")
    got = {(r.list_name, r.sense, r.algo, r.hash) for r in known.hash_list(df, "l", "allow").collect()}
    assert got == {("l", "allow", "md5", M), ("l", "allow", "sha1", S1), ("l", "allow", "sha256", S2)}


def test_priority_matches_equal_a_nested_loop(spark):
    rng = random.Random(1)
    digest = {a: [getattr(hashlib, a)(bytes([i])).hexdigest() for i in range(8)] for a in ("md5", "sha1", "sha256")}
    files = []
    for i in range(200):
        k = rng.randrange(8)
        files.append((1, i, *[digest[a][k].upper() if rng.random() < 0.3 else digest[a][k] if rng.random() < 0.7 else rng.choice([None, ""]) for a in digest]))
    lists = [(f"l{n}", rng.choice(["allow", "block"]), a, rng.choice(digest[a])) for n in range(3) for a in digest for _ in range(2)]
    senses = {n: s for n, s, _, _ in reversed(lists)}
    lists = [(n, senses[n], a, h) for n, _, a, h in lists]
    fdf = spark.createDataFrame(files, "evidence_source_id long, file_id long, md5 string, sha1 string, sha256 string")
    ldf = spark.createDataFrame(lists, "list_name string, sense string, algo string, hash string")
    out = known.match_lists(fdf, ldf)
    assert quality.schema_drift(out, schemas.KNOWN_FILE_MATCHES) == []
    want = set()
    for _, fid, *values in files:
        for name in senses:
            for algo, v in zip(("md5", "sha1", "sha256"), values):
                if v and (name, senses[name], algo, v.lower()) in lists:
                    want.add((fid, name, senses[name], algo))
                    break
    got = [(r.file_id, r.list_name, r.sense, r.matched_on) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)


def test_reference_is_upper_case_and_may_repeat(spark):
    ref = spark.createDataFrame([(M.upper(), S1.upper(), None), (M.upper(), None, None)], "md5 string, sha1 string, sha256 string")
    files = spark.createDataFrame([(1, 1, M, S1, S2), (1, 2, None, S1, None), (1, 3, "0" * 32, None, None)], "evidence_source_id long, file_id long, md5 string, sha1 string, sha256 string")
    got = {(r.file_id, r.matched_on, r.source, r.sense) for r in known.match_reference(files, known.reference_hashes(ref)).collect()}
    assert got == {(1, "md5", "nsrl", None), (2, "sha1", "nsrl", None)}


def test_matches_become_hits_with_the_digest(spark):
    files = spark.createDataFrame([(1, 1, 2, 512, "/m", M, S1, S2)], "evidence_source_id long, file_id long, volume_id long, volume_offset long, path string, md5 string, sha1 string, sha256 string")
    ldf = spark.createDataFrame([("known-bad", "block", "sha1", S1)], "list_name string, sense string, algo string, hash string")
    hits = known.hash_hits(known.match_lists(files, ldf), files)
    assert quality.schema_drift(hits, schemas.SEARCH_HITS) == []
    row = hits.first()
    assert (row.term, row.term_kind, row.region, row.byte_offset, row.path) == (S1, "hash", "metadata", None, "/m")
    assert row.attributes == '{"list":"known-bad","matched_on":"sha1"}'


def test_no_column_carries_a_verdict():
    for schema in schemas.TABLES.values():
        assert not [n for n in schema.fieldNames() if any(w in n for w in schemas.VERDICT_WORDS)]


def test_a_digest_shared_by_a_third_of_the_files(spark):
    files = spark.range(30000).select(
        F.lit(1).cast("long").alias("evidence_source_id"), F.col("id").alias("file_id"),
        F.when(F.col("id") % 3 == 0, F.lit(M)).otherwise(F.md5(F.col("id").cast("string"))).alias("md5"),
        F.lit(None).cast("string").alias("sha1"), F.lit(None).cast("string").alias("sha256"),
    )
    ldf = spark.createDataFrame([("l", "allow", "md5", M)], "list_name string, sense string, algo string, hash string")
    assert known.match_lists(files, ldf).count() == 10000
