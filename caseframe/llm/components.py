"""Connected components of a table of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.llm import storage


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked with the node's least neighbour."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are linked with the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least)


def components(links: DataFrame) -> DataFrame:
    """(id, label): every node of ``links`` (a, b) with the least node that it is connected to.

    Alternates the two star steps until nothing changes; each round's links are
    written to the shared folder. A node with very many links is a hot key of
    joins, which adaptive execution splits, never a collected list.
    """
    now = storage.staged(links.filter("a <> b").select("a", "b").distinct(), "links")
    before, state = None, _state(now)
    while state != before:
        step = _small_star(_large_star(now).distinct()).filter("a <> b").distinct()
        now = storage.staged(step, "links")
        before, state = state, _state(now)
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    )
