"""Registered queries against their SQL on small tables that the generated ones do not hold."""

import os
import sys

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import check_queries  # noqa: E402

from caseframe.plans import catalog  # noqa: E402


def documents(spark, folder, texts):
    rows = [(k, text, "en", "web", len(text or "")) for k, text in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")


def both(spark, folder, name):
    df = catalog.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    cur = con.execute(catalog.oracle_sql()[name])
    return check_queries.multiset(df.columns, df.collect()), check_queries.multiset([c[0] for c in cur.description], cur.fetchall())


def test_recovered_content_of_records_that_name_a_size_below_zero(spark, tmp_path):
    texts = [(11 * i + 3, "abcdé"[: i % 5]) for i in range(40)] + [(200 * 11, None), (201 * 11, ""), (2, "x" * 300)]
    documents(spark, tmp_path, texts)
    mine, theirs = both(spark, tmp_path, "recovered_content")
    assert mine == theirs and any(min(v for v in row if isinstance(v, int)) < 0 for row in mine)
