"""Known-hash matching: provenance of a match, never a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.functions import hashes
from caseframe.functions.attributes import flags_json
from caseframe.operators.ordered import bind

PRIORITY = {"md5": 1, "sha1": 2, "sha256": 3}


def hash_list(lines: DataFrame, list_name: str, sense: str, line_col: str = "value") -> DataFrame:
    """List lines to distinct (list_name, sense, algo, hash); bad tokens are skipped."""
    stripped = bind(lines.select(line_col), "_s", F.regexp_replace(F.col(line_col), r"^\s+|\s+$", ""))
    kept = stripped.where((F.col("_s") != "") & ~F.startswith(F.col("_s"), F.lit("#")))
    tokens = bind(kept, "hash", F.lower(F.get(F.split("_s", r"\s+", 2), 0)))
    return (
        tokens.select(hashes.algorithm_of(F.col("hash")).alias("algo"), "hash")
        .where(F.col("algo").isNotNull() & hashes.is_hex(F.col("hash")))
        .distinct()
        .select(F.lit(list_name).alias("list_name"), F.lit(sense).alias("sense"), "algo", "hash")
    )


def reference_hashes(table: DataFrame) -> DataFrame:
    """(algo, hash) of a reference table with md5/sha1/sha256 columns.

    The table stores upper case; it is folded here once, so file digests are
    compared as they are. Duplicates may stay.
    """
    columns = ", ".join(f"'{a}', {a}" for a in hashes.ALGORITHMS if a in table.columns)
    width = sum(a in table.columns for a in hashes.ALGORITHMS)
    return (
        table.selectExpr(f"stack({width}, {columns}) as (algo, hash)")
        .where("hash is not null and hash <> ''")
        .select("algo", F.lower("hash").alias("hash"))
    )


def file_digests(files: DataFrame) -> DataFrame:
    """(evidence_source_id, file_id, algo, hash), one row per recorded digest."""
    return (
        files.select(
            "evidence_source_id",
            "file_id",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(a).alias("algo"), F.lower(F.col(a)).alias("hash"))
                        for a in hashes.ALGORITHMS
                    ]
                )
            ).alias("d"),
        )
        .where("d.hash is not null and d.hash <> ''")
        .select("evidence_source_id", "file_id", "d.algo", "d.hash")
    )


def _best(matches: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the digest of highest priority that matched."""
    rank = F.lit(None).cast("int")
    for algo, prio in PRIORITY.items():
        rank = F.when(F.col("algo") == algo, prio).otherwise(rank)
    return (
        matches.groupBy(*keys)
        .agg(F.min(rank).alias("_p"))
        .withColumn(
            "matched_on",
            F.element_at(F.array(*[F.lit(a) for a in hashes.ALGORITHMS]), F.col("_p")),
        )
        .drop("_p")
    )


def match_lists(files: DataFrame, lists: DataFrame) -> DataFrame:
    """At most one match per (file, list).

    A digest shared by many files is a hot key on the file side only (a list
    holds it once), which adaptive skew handling splits. Catalyst broadcasts
    the lists when their measured size allows it.
    """
    joined = file_digests(files).join(lists, ["algo", "hash"])
    best = _best(joined, ["evidence_source_id", "file_id", "list_name", "sense"])
    return best.select(
        "evidence_source_id",
        "file_id",
        F.lit("custom").alias("source"),
        "list_name",
        "sense",
        "matched_on",
    )


def match_reference(files: DataFrame, reference: DataFrame) -> DataFrame:
    """Membership in the reference set; duplicates in the set do not multiply.

    They are removed first: that is dealt like the join, costs it no exchange of
    its own, and leaves no digest that is hot on the reference side.
    """
    distinct = reference.dropDuplicates(["algo", "hash"])
    joined = file_digests(files).join(distinct, ["algo", "hash"], "left_semi")
    best = _best(joined, ["evidence_source_id", "file_id"])
    none = F.lit(None).cast("string")
    return best.select(
        "evidence_source_id",
        "file_id",
        F.lit("nsrl").alias("source"),
        none.alias("list_name"),
        none.alias("sense"),
        "matched_on",
    )


def with_file_columns(matches: DataFrame, files: DataFrame) -> DataFrame:
    """Matches with the place of their file, for scoping and ordering."""
    place = files.select("evidence_source_id", "file_id", "volume_id", "volume_offset", "path")
    return matches.join(place, ["evidence_source_id", "file_id"])


def hash_hits(matches: DataFrame, files: DataFrame) -> DataFrame:
    """Known-hash matches as search hits carrying the matched digest."""
    place = files.select(
        "evidence_source_id",
        "file_id",
        "volume_id",
        "volume_offset",
        "path",
        *hashes.ALGORITHMS,
    )
    rows = matches.join(place, ["evidence_source_id", "file_id"])
    digest = F.lit(None).cast("string")
    for algo in hashes.ALGORITHMS:
        digest = F.when(F.col("matched_on") == algo, F.col(algo)).otherwise(digest)
    none = F.lit(None)
    return rows.select(
        "evidence_source_id",
        "file_id",
        F.lit("metadata").alias("region"),
        F.coalesce(F.nullif(digest, F.lit("")), F.col("matched_on")).alias("term"),
        F.lit("hash").alias("term_kind"),
        "volume_id",
        "volume_offset",
        none.cast("long").alias("byte_offset"),
        none.cast("long").alias("block_index"),
        "path",
        none.cast("string").alias("context"),
        flags_json(list=F.col("list_name"), matched_on=F.col("matched_on")).alias("attributes"),
    )
