"""The registered queries of the operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from caseframe.llm import (
    bpe,
    contamination,
    copies,
    disclosure,
    jaccard,
    langid,
    licences,
    loglinear,
    perplexity,
    ranking,
    repair,
    secrets,
    suffixes,
)
from caseframe.session import pin


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents"), texts=False)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digests(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents")
    pin(spark, bpe.BATCH)
    return bpe.digests(docs, vocabulary, public_tokenizers.PATTERN)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judged(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digests(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loglinear.scores(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audits(repair.damaged(table(spark, sf_dir, "conversations")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.exact_copies(table(spark, sf_dir, "documents"), stored=True)


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_suffix_array_dedup,
    op2_ngram_jaccard_join,
    op3_licence_scan,
    op4_byte_bpe,
    op5_quality_rules,
    op6_language_id,
    op7_pii,
    op8_lm_scoring,
    op9_secret_scan,
    op10_benchmark_decontamination,
    op11_conversation_repair,
    op12_ranked_search,
    op13_exact_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_benchmark_decontamination": contamination.ORACLE_SQL.strip(),
        "op12_ranked_search": ranking.ORACLE_SQL.strip(),
        "op13_exact_dedup": copies.ORACLE_SQL.strip(),
    }
