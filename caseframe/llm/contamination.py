"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of 13 words (a shorter item is one window). A
window occurs in a document only if each of its words does, so its rarest word
is a necessary prefix token: words are ordered by their number of occurrences
in the documents, documents join on the rarest word of each window, the word's
place fixes where the window would start, and the window is then compared in
full at that place.

Null and empty texts have no words. An item without words has no windows; an
item without id marks words but is not listed. Rows are judged one by one, also
when they share a ``doc_id`` or have none. Column names of the inputs other
than key and text do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.llm import storage

WINDOW = 13
#: A document is contaminated from this share of hit words on: 20 * n_hit >= n_words.
HIT_FACTOR = 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The matches of ``WORD``: what stands between those of its complement, which costs far less than to extract each match."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def item_windows(items: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(item_id, win): the windows of every item as words joined by spaces."""
    split = items.select(F.col(key).alias("item_id"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    placed = split.select("item_id", "w", F.explode(starts).alias("s"))
    return placed.select("item_id", F.array_join(F.slice("w", F.col("s"), F.lit(width)), " ").alias("win")).distinct()


def prefix_tokens(windows: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(word, win, place): the rarest word of each window and its first place there.

    A window with a word that no document has cannot occur and is left out.
    """
    each = windows.select("win", F.posexplode(F.split("win", " ")).alias("place", "word"))
    ranked = each.join(occurrences, "word", "left").groupBy("win").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("rarest")
    )
    return ranked.filter("rarest.n > 0").select("rarest.word", "win", "rarest.place")


def occurrences(docs: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """(word, n): how often each word of ``vocabulary`` stands in the documents."""
    each = docs.select(F.explode(words(F.col(text))).alias("word"))
    return each.join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))


def _judged(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", width: int = WINDOW,
) -> DataFrame:
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    windows = storage.staged(item_windows(items, item_key, item_text, width), "windows")
    vocabulary = storage.staged(windows.select(F.explode(F.split("win", " ")).alias("word")).distinct(), "window-words")
    counted = storage.staged(occurrences(docs, "text", vocabulary), "word-counts")
    prefix = storage.staged(prefix_tokens(windows.select("win").distinct(), counted), "prefix-tokens")

    # Only the words are needed to meet a window: the text is not carried through this join.
    tokens = prefix.select("word").distinct()
    met = docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("at", "word")).join(tokens, "word", "left_semi")
    start = F.col("at") - F.col("place")
    candidates = met.join(prefix, "word").filter(start >= 0).select("doc_id", start.alias("start"), "win").distinct()
    by_doc = candidates.groupBy("doc_id").agg(F.collect_list(F.struct("start", "win")).alias("candidates"))

    read = docs.join(by_doc.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")), "left").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("candidates", F.array()).alias("candidates"), words(F.col("text")).alias("w")
    )
    length = lambda c: F.size(F.split(c["win"], " "))
    fits = lambda c: c["start"] + length(c) <= F.size("w")
    same = lambda c: F.array_join(F.slice("w", c["start"] + 1, length(c)), " ") == c["win"]
    found = read.select(
        "doc_id", "text_hash", F.coalesce(F.size("w"), F.lit(0)).cast("long").alias("n_words"), F.filter("candidates", lambda c: fits(c) & same(c)).alias("found")
    )
    places = F.flatten(F.transform("found", lambda c: F.sequence(c["start"], c["start"] + length(c) - 1)))
    judged = storage.staged(
        found.select(
            "doc_id", "text_hash", F.greatest("n_words", F.lit(0)).alias("n_words"), F.size(F.array_distinct(places)).cast("long").alias("n_hit"),
            F.array_distinct(F.transform("found", lambda c: c["win"])).alias("wins"),
        ),
        "hit-windows",
    )
    listed = (
        judged.select("doc_id", "text_hash", F.explode("wins").alias("win")).distinct()
        .join(windows.filter("item_id IS NOT NULL"), "win").select("doc_id", "text_hash", "item_id").distinct()
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
        .select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "items")
    )
    same_row = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return judged.join(listed, same_row, "left").select(
        "doc_id", "text_hash", "n_words", "n_hit", F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (HIT_FACTOR * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", **columns: str) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    return _judged(docs, items, key, **columns).drop("text_hash").withColumnRenamed("doc_id", key)


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **columns: str) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    dirty = _judged(docs, items, key, text, **columns).filter("contaminated")
    gone = storage.staged(dirty.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "contaminated")
    same = F.col(key).eqNullSafe(F.col("gone_id")) & (F.xxhash64(text) == F.col("gone_hash"))
    return docs.join(gone, same, "left_anti")


ORACLE_SQL = rf"""
WITH item AS (
    SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
    SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[s : s + {WINDOW} - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM item WHERE len(w) > 0)
), doc AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w FROM documents
), place AS (
    SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (SELECT place.* FROM place WHERE win IN (SELECT win FROM win)
), hits AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit JOIN win USING (win)) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {HIT_FACTOR} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
