"""Which files are logs, who parses them, and in which order a rotated set reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseframe.functions import names

# Base names of rotated sets and shell history leaf names.
LOG_BASES = ("auth.log", "secure", "syslog", "messages")
HISTORY_LEAVES = (".bash_history", ".zsh_history", ".history")

# Finding texts.
NOTE_COMPLETE = "log set reassembled oldest→newest"
NOTE_HISTORY = "shell history is a single, non-rotated per-user file"
TAMPERABILITY = (
    "tamperability: shell history is editable by the subject (e.g. `history "
    "-c`) and its line order is NOT chronological truth — treat commands as "
    "observed evidence only, never as proof of timing or intent (D-44)."
)

# A gap of more indices than this is listed by its two ends; the note gives it as a range.
MAX_LISTED_GAP = 1000

# Leaf of a rotated member: a base, alone, with a dotted suffix or with a dash date.
_MEMBER = r"(?s)^(" + "|".join(b.replace(".", r"\.") for b in LOG_BASES) + r")(?:\..*|-\d{8}(?:\.gz)?)?$"
_INDEX = r"^[a-z]+(?:\.log)?\.(\d+)(?:\.gz)?$"
_DATE = r"^[a-z]+(?:\.log)?[.-](\d{8})(?:\.gz)?$"


def _group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def members(files: DataFrame) -> DataFrame:
    """Log members among the files, with set, rotation index and date.

    ``set_key`` is the directory and base name of a rotated set, or the full
    path of a history file. A dated suffix is a date, never an index. The live
    file and suffixes that are neither have index 0.
    """
    leaf, history, base = F.col("_leaf"), F.col("is_history"), F.col("base")
    return (
        files.withColumn("_leaf", names.leaf(F.col("path")))
        .withColumns({"base": _group(leaf, _MEMBER), "is_history": leaf.isin(*HISTORY_LEAVES)})
        .where("base is not null or is_history")
        .withColumn("date_suffix", F.when(~history, _group(leaf, _DATE)))
        .withColumn(
            "rotation_index",
            F.when(
                F.col("date_suffix").isNull(),
                F.coalesce(F.when(~history, _group(leaf, _INDEX)).try_cast("long"), F.lit(0)),
            ),
        )
        .withColumns(
            {
                "is_gz": ~history & leaf.endswith(".gz"),
                "set_key": F.when(history, F.col("path")).otherwise(
                    F.concat(names.parent_dir(F.col("path")), F.lit("/"), base)
                ),
                "subject": F.when(history, F.col("path")).otherwise(base),
            }
        )
        .drop("_leaf")
    )


def set_of_path(path: Column) -> Column:
    """Directory and base name of a rotated member, the path itself for anything else."""
    base = _group(names.leaf(path), _MEMBER)
    return F.coalesce(F.concat(names.parent_dir(path), F.lit("/"), base), path)


def place_of_path(path: Column) -> dict[str, Column]:
    """Order columns of a member inside its set, oldest first; the path breaks ties."""
    leaf = names.leaf(path)
    date = _group(leaf, _DATE).try_cast("long")
    index = F.coalesce(_group(leaf, _INDEX).try_cast("long"), F.lit(0))
    return {
        # Numbered members count down to the live file; dates lie between.
        "_place": F.when(date.isNotNull(), date).when(index > 0, -index).otherwise(F.lit(100_000_000)),
        "_plain": F.when(leaf.endswith(".gz"), 0).otherwise(1),
    }


def rotation_order() -> list[Column]:
    """Oldest to newest: higher index first, then dates ascending, the live file last.

    At one position the compressed copy is the older one.
    """
    return [
        F.coalesce(F.col("rotation_index"), F.lit(0)).desc(),
        F.coalesce(F.col("date_suffix"), F.lit("99999999")).asc(),
        F.col("is_gz").desc(),
        F.col("path").asc(),
    ]


def with_rotation_position(member_rows: DataFrame) -> DataFrame:
    """1-based position oldest to newest; a set has one row per file of a directory."""
    w = W.partitionBy("volume_id", "set_key").orderBy(*rotation_order())
    return member_rows.withColumn("position", F.row_number().over(w).cast("long"))


def completeness(member_rows: DataFrame) -> DataFrame:
    """One finding per set: indices present, indices missing below the highest.

    Missing indices come from the gaps between neighbouring present indices.
    ``missing_ranges`` holds every gap (first, last); ``missing_indices`` lists
    those of gaps up to ``MAX_LISTED_GAP``, as a file name can claim any index.
    """
    keys = ["evidence_source_id", "volume_id", "set_key", "subject", "is_history"]
    counts = member_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("member_count"))
    distinct = member_rows.where("rotation_index is not null").select(*keys, "rotation_index").distinct()
    w = W.partitionBy(*keys).orderBy("rotation_index")
    gaps = distinct.withColumn("_prev", F.coalesce(F.lag("rotation_index").over(w), F.lit(-1)))
    per_set = gaps.groupBy(*keys).agg(
        F.array_sort(F.collect_list("rotation_index")).alias("present_indices"),
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("rotation_index") - F.col("_prev") > 1,
                    F.struct((F.col("_prev") + 1).alias("first"), (F.col("rotation_index") - 1).alias("last")),
                )
            )
        ).alias("_gaps"),
    )
    rows = counts.join(per_set, keys, "left")
    empty = F.array().cast("array<bigint>")
    spans = F.coalesce(F.col("_gaps"), F.array().cast("array<struct<first:bigint,last:bigint>>"))
    long_gap = lambda g: g["last"] - g["first"] >= MAX_LISTED_GAP
    short = F.filter(spans, lambda g: ~long_gap(g))
    missing = F.flatten(F.transform(short, lambda g: F.sequence(g["first"], F.least(g["last"], g["first"] + MAX_LISTED_GAP))))
    told = F.transform(
        spans,
        lambda g: F.when(long_gap(g), F.concat_ws("-", g["first"], g["last"])).otherwise(
            F.array_join(F.sequence(g["first"], F.least(g["last"], g["first"] + MAX_LISTED_GAP)).cast("array<string>"), ", ")
        ),
    )
    note = (
        F.when(F.col("is_history"), NOTE_HISTORY)
        .when(F.size(spans) == 0, NOTE_COMPLETE)
        .otherwise(
            F.concat(
                F.lit("log set may be incomplete: rotation indices ["),
                F.array_join(told, ", "),
                F.lit("] absent (rotated out / never present)"),
            )
        )
    )
    return rows.select(
        "evidence_source_id",
        "volume_id",
        "set_key",
        "subject",
        F.coalesce(F.col("present_indices"), empty).alias("present_indices"),
        missing.alias("missing_indices"),
        spans.alias("missing_ranges"),
        "member_count",
        note.alias("note"),
    )


def damage_findings(damaged: DataFrame) -> DataFrame:
    """Findings table rows for members that cannot be read (``text.damaged_members``)."""
    none = F.lit(None)
    return damaged.select(
        "evidence_source_id",
        F.lit("damage").alias("category"),
        F.col("path").alias("subject"),
        F.concat(F.lit("compressed log member could not be read: "), F.col("reason")).alias("detail"),
        none.cast("array<bigint>").alias("present_indices"),
        none.cast("array<bigint>").alias("missing_indices"),
        none.cast("array<struct<first:bigint,last:bigint>>").alias("missing_ranges"),
        none.cast("long").alias("member_count"),
    )


def disclosures(member_rows: DataFrame, read_paths: DataFrame | None = None) -> DataFrame:
    """Findings table: completeness per set, tamperability per history file.

    ``read_paths`` (volume_id, path) restricts tamperability to members that
    had text; without it every history member is disclosed.
    """
    full = completeness(member_rows).select(
        "evidence_source_id",
        F.lit("completeness").alias("category"),
        "subject",
        F.col("note").alias("detail"),
        "present_indices",
        "missing_indices",
        "missing_ranges",
        "member_count",
    )
    history = member_rows.where("is_history")
    if read_paths is not None:
        history = history.join(read_paths.distinct(), ["volume_id", "path"], "left_semi")
    none = F.lit(None)
    tamper = history.select("evidence_source_id", "volume_id", "path").distinct().select(
        "evidence_source_id",
        F.lit("tamperability").alias("category"),
        F.col("path").alias("subject"),
        F.lit(TAMPERABILITY).alias("detail"),
        none.cast("array<bigint>").alias("present_indices"),
        none.cast("array<bigint>").alias("missing_indices"),
        none.cast("array<struct<first:bigint,last:bigint>>").alias("missing_ranges"),
        none.cast("long").alias("member_count"),
    )
    return full.unionByName(tamper)


def with_file_id(member_rows: DataFrame, files: DataFrame) -> DataFrame:
    """First file id of the member path; NULL when the path is not in the inventory.

    The inventory is cut down to the member paths before it is grouped.
    """
    wanted = member_rows.select("evidence_source_id", "path").distinct()
    files = files.join(wanted, ["evidence_source_id", "path"], "left_semi")
    first = files.groupBy("evidence_source_id", "path").agg(F.min("file_id").alias("file_id"))
    return member_rows.drop("file_id").join(first, ["evidence_source_id", "path"], "left")
