"""Deleted inodes: discovery, orphans, block overlap and survival tiers.

Block runs are (start, len) pairs. They are cut at fixed bucket edges, so an
overlap is an equi-join on the bucket; the allocated side of a bucket is one
row holding disjoint intervals, whatever the number of files in it. Runs are
merged to intervals and these are intersected and complemented; they are not
laid out to their blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseframe.functions import attributes, hashes, names, signatures
from caseframe.operators import ordered
from caseframe.schemas import FILES

INTACT = "intact"
OVERWRITTEN = "partial/overwritten"
BUCKET = 1024
WORD = 64
MAX_LISTED = 32
TOO_BIG = "exceeds_max_hash_size"

# Rationale texts.
REASON_REALLOCATED = "inode reallocated to a live file at recover time"
REASON_RESIDENT = "resident data recovered from the MFT record"
REASON_NO_RUNS = "no recoverable data runs (block pointers cleared on unlink)"
REASON_OVERLAP = "data blocks reallocated to an allocated file"
REASON_INTACT = "all surviving data blocks still unallocated"
#: Ours: a name whose inode is not in the scan.
REASON_NO_INODE = "inode not in the scan; nothing is known of its data"
CAVEAT_RESIDENT = (
    "Resident data recovered from the MFT record (the entry was small enough "
    "to be stored inside its metadata record, so it has no separate data "
    "blocks)."
)
CAVEAT_NO_RUNS = (
    "ext4 clears an inode's block pointers on unlink, so most deleted ext4 "
    "entries expose no recoverable data runs; signature carving (a later "
    "capability) is the path for those."
)


def runs_of_blocks(inodes: DataFrame, column: str = "data_blocks") -> DataFrame:
    """Block lists as runs of length one."""
    return inodes.withColumn(
        "runs",
        F.transform(column, lambda b: F.struct(b.alias("start"), F.lit(1).cast("long").alias("len"))),
    )


def bucket_pieces(inodes: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """keys, bucket, lo, hi (exclusive): every run cut at the bucket edges."""
    run = inodes.select(*keys, F.explode("runs").alias("r")).where("r.len > 0")
    cut = run.select(
        *keys,
        F.col("r.start").alias("_s"),
        (F.col("r.start") + F.col("r.len")).alias("_e"),
        F.explode(
            F.sequence(F.expr(f"r.start div {bucket}"), F.expr(f"(r.start + r.len - 1) div {bucket}"))
        ).alias("bucket"),
    )
    return cut.select(
        *keys,
        "bucket",
        F.greatest(F.col("_s"), F.col("bucket") * bucket).alias("lo"),
        F.least(F.col("_e"), (F.col("bucket") + 1) * bucket).alias("hi"),
    )


def islands(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bucket, lo, hi: the pieces of each key and bucket as disjoint intervals.

    The first aggregation keeps the longest piece per start, so at most one row
    per block of a bucket reaches the window.
    """
    part = [*keys, "bucket"]
    longest = pieces.groupBy(*part, "lo").agg(F.max("hi").alias("hi"))
    w = W.partitionBy(*part).orderBy("lo")
    reach = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = longest.withColumn("_new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(0)))
    grouped = marked.withColumn("_g", F.sum("_new").over(w))
    return grouped.groupBy(*part, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")


def allocated_intervals(inodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """volume_id, bucket, lo, hi: disjoint blocks owned by allocated inodes."""
    return islands(bucket_pieces(inodes.where("allocated"), ["volume_id"], bucket), ["volume_id"])


def _taken(inodes: DataFrame, bucket: int) -> DataFrame:
    """volume_id, bucket, taken: the intervals of a bucket in one row, at most one for every second block."""
    owned = allocated_intervals(inodes, bucket)
    return owned.groupBy("volume_id", "bucket").agg(F.collect_list(F.struct("lo", "hi")).alias("taken"))


def block_overlap(inodes: DataFrame, bucket: int = BUCKET, listed: int = MAX_LISTED) -> DataFrame:
    """Deleted inodes that share blocks with allocated ones.

    volume_id, meta_addr, n_shared (how many blocks are shared, each counted
    once), overlapping_blocks (the lowest ``listed`` of them, ascending).
    """
    inode = ["volume_id", "meta_addr"]
    own = islands(bucket_pieces(inodes.where("allocated is not true"), inode, bucket), inode)
    shared = F.filter(
        F.transform(
            "taken",
            lambda t: F.struct(F.greatest(t["lo"], F.col("lo")).alias("lo"), F.least(t["hi"], F.col("hi")).alias("hi")),
        ),
        lambda t: t["lo"] < t["hi"],
    )
    intervals = own.join(_taken(inodes, bucket), ["volume_id", "bucket"]).select(*inode, F.explode(shared).alias("s")).select(*inode, "s.*")
    # Of an inode's intervals the lowest ``listed`` hold the blocks to list; the number counts them all.
    w = W.partitionBy(*inode).orderBy("lo")
    lowest = F.when(F.row_number().over(w) <= listed, F.sequence("lo", F.least(F.col("hi"), F.col("lo") + listed) - 1))
    return (
        intervals.withColumn("_low", lowest)
        .groupBy(*inode)
        .agg(
            F.sum(F.col("hi") - F.col("lo")).alias("n_shared"),
            F.slice(F.array_sort(F.flatten(F.collect_list("_low"))), 1, listed).alias("overlapping_blocks"),
        )
    )


def unallocated(blocks: DataFrame, inodes: DataFrame, bucket: int = WORD) -> DataFrame:
    """Blocks owned by no allocated inode.

    A block meets the word of its ``bucket`` (64 at most) neighbours, a bit a
    block; no interval is laid out to its blocks.
    """
    width = min(bucket, WORD)
    pieces = bucket_pieces(inodes.where("allocated"), ["volume_id"], width).where("lo < hi")
    ones = F.expr(f"shiftrightunsigned(-1L, cast({WORD} - (hi - lo) as int))")
    words = pieces.select("volume_id", F.col("bucket").alias("_bucket"), ones.alias("ones"), F.expr(f"cast(lo - bucket * {width} as int)").alias("at"))
    taken = words.groupBy("volume_id", "_bucket").agg(F.bit_or(F.expr("shiftleft(ones, at)")).alias("taken"))
    place = F.expr(f"pmod(block_index, {width})")
    number = F.expr(f"(block_index - pmod(block_index, {width})) div {width}")
    owned = F.bit_get(F.col("taken"), place.cast("int")) == 1
    joined = blocks.withColumn("_bucket", number).join(taken, ["volume_id", "_bucket"], "left")
    return joined.where(~F.coalesce(owned, F.lit(False))).select(*blocks.columns)


def unallocated_runs(volumes: DataFrame, inodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """volume_id, volume_offset, start, len: the longest runs of blocks that no allocated inode owns.

    ``volumes``: volume_id, volume_offset, block_count. The complement of the
    allocated intervals: a free run lies between an interval and the one before
    it, which may be in another bucket; a volume of any length is followed by
    segments.
    """
    sized = volumes.select("volume_id", "volume_offset", "block_count")
    owned = allocated_intervals(inodes, bucket).select("volume_id", "lo", "hi")
    before = ordered.with_previous(owned, ["volume_id"], ["lo"], ["hi"], out="_prev", rows=bucket * 256)
    start = F.coalesce(F.col("_prev.hi"), F.lit(0).cast("long"))
    between = before.select("volume_id", start.alias("start"), F.col("lo").alias("end"))
    last = owned.groupBy("volume_id").agg(F.max("hi").alias("start"))
    behind = sized.select("volume_id", F.col("block_count").alias("end")).join(last, "volume_id", "left")
    behind = behind.select("volume_id", F.coalesce("start", F.lit(0).cast("long")).alias("start"), "end")
    runs = between.unionByName(behind).join(sized, "volume_id")
    end = F.least(F.col("end"), F.col("block_count"))
    return runs.select("volume_id", "volume_offset", "start", (end - F.col("start")).alias("len")).where("len > 0")


def block_numbers(volumes: DataFrame, step: int = 1 << 16) -> DataFrame:
    """All block numbers of each volume (volume_id, volume_offset, block_count)."""
    chunks = volumes.where("block_count > 0").select(
        "volume_id",
        "volume_offset",
        "block_count",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(block_count - 1) div {step}"))).alias("_c"),
    )
    return chunks.repartition("volume_id", "_c").select(
        "volume_id",
        "volume_offset",
        F.explode(
            F.sequence(
                F.col("_c") * step, F.least(F.col("block_count"), (F.col("_c") + 1) * step) - 1
            )
        ).alias("block_index"),
    )


def with_orphan_test(deleted: DataFrame, inodes: DataFrame) -> DataFrame:
    """``is_orphan``: no parent, parent not an allocated inode, or flagged.

    Rows without a parent get a join key of their own that matches nothing;
    as NULL they would all meet in one partition.
    """
    live = (
        inodes.where("allocated")
        .select("volume_id", F.col("meta_addr").alias("_parent"))
        .distinct()
        .withColumn("_live", F.lit(True))
    )
    keyed = deleted.withColumn("_parent", F.coalesce("parent_addr", -F.col("meta_addr") - 1))
    return (
        keyed.join(live, ["volume_id", "_parent"], "left")
        .withColumn(
            "is_orphan",
            F.col("_live").isNull() | F.coalesce(F.col("orphan_flag"), F.lit(False)),
        )
        .drop("_live", "_parent")
    )


def deleted_inodes(entries: DataFrame, inodes: DataFrame) -> DataFrame:
    """Deleted regular inodes from the directories, then from the inode scan.

    ``entries``: volume_id, volume_offset, meta_addr, name, path, parent_addr,
    allocated, meta_type, entry_ordinal. A directory link wins, the first one
    in entry order; scan rows need content and get a synthetic path.
    """
    linked = entries.where("allocated <=> false and meta_addr is not null and meta_type = 'reg'")
    first = linked.groupBy("volume_id", "volume_offset", "meta_addr").agg(
        F.min_by(F.struct("name", "path", "parent_addr"), "entry_ordinal").alias("e")
    )
    flags = inodes.groupBy("volume_id", "meta_addr").agg(F.max("orphan_flag").alias("orphan_flag"))
    named = first.select("volume_id", "volume_offset", "meta_addr", "e.*").join(
        flags, ["volume_id", "meta_addr"], "left"
    )
    from_dirs = with_orphan_test(named, inodes).withColumn("found_by", F.lit("directory"))
    scan = inodes.where("allocated <=> false and meta_type = 'reg' and size > 0").join(
        first.select("volume_id", "meta_addr"), ["volume_id", "meta_addr"], "left_anti"
    )
    addr = F.col("meta_addr").cast("string")
    from_scan = scan.select(
        "volume_id",
        "volume_offset",
        "meta_addr",
        F.concat(F.lit("inode-"), addr).alias("name"),
        F.concat(F.lit("/$OrphanFiles/"), addr).alias("path"),
        F.lit(None).cast("long").alias("parent_addr"),
        "orphan_flag",
        F.lit(True).alias("is_orphan"),
        F.lit("scan").alias("found_by"),
    )
    return from_dirs.unionByName(from_scan)


def tier_columns(overlap: Column) -> dict[str, Column]:
    """Tier, reason and caveat from the inode columns; the first case that holds decides."""
    runs = F.coalesce(F.size("runs"), F.lit(0))
    no_runs = runs <= 0
    resident = no_runs & F.coalesce(F.col("has_resident_data"), F.lit(False))
    cleared = no_runs & (F.coalesce(F.col("size"), F.lit(0)) > 0)
    hit = F.coalesce(F.size(overlap), F.lit(0)) > 0
    live = F.coalesce(F.col("now_allocated"), F.lit(False))

    def pick(on_live, on_resident, on_cleared, on_hit, otherwise) -> Column:
        def c(v):
            return F.lit(v).cast("string")

        return (
            F.when(live, c(on_live))
            .when(resident, c(on_resident))
            .when(cleared, c(on_cleared))
            .when(hit, c(on_hit))
            .otherwise(c(otherwise))
        )

    return {
        "confidence_tier": pick(OVERWRITTEN, INTACT, OVERWRITTEN, OVERWRITTEN, INTACT),
        "tier_reason": pick(
            REASON_REALLOCATED, REASON_RESIDENT, REASON_NO_RUNS, REASON_OVERLAP, REASON_INTACT
        ),
        "tier_caveat": pick(None, CAVEAT_RESIDENT, CAVEAT_NO_RUNS, None, None),
        "overlapping_blocks": F.when(~live & ~resident & ~cleared & hit, overlap),
    }


def with_tier(inodes: DataFrame, bucket: int = BUCKET, live: bool = False) -> DataFrame:
    """Deleted inodes with their survival tier and its rationale.

    With ``live`` also the allocated inodes, as a deleted name may point to an
    inode that was given to another file since.
    """
    overlap = block_overlap(inodes, bucket).withColumnRenamed("overlapping_blocks", "_overlap").drop("n_shared")
    chosen = inodes.where("allocated is not true")
    if live:
        taken = F.col("allocated") if "now_allocated" not in inodes.columns else F.col("allocated") | F.col("now_allocated")
        chosen = inodes.withColumn("now_allocated", F.coalesce(taken, F.col("allocated"), F.lit(False)))
    rows = chosen.join(overlap, ["volume_id", "meta_addr"], "left")
    return rows.withColumns(tier_columns(F.col("_overlap"))).drop("_overlap")


def recovered_file_id(volume_id: Column, meta_addr: Column) -> Column:
    """Negative id of a recovered inode; inventory ids are not negative."""
    return -(volume_id * (1 << 44) + meta_addr) - 1


def recovered_rows(
    deleted: DataFrame,
    tiers: DataFrame,
    evidence_source_id: int,
    contents: DataFrame | None = None,
    max_hash_size: int | None = None,
    digests: DataFrame | None = None,
) -> DataFrame:
    """Deleted inodes in the shape of the ``files`` table.

    ``deleted`` comes from ``deleted_inodes``, ``tiers`` from ``with_tier``,
    with its live inodes. A name whose inode is not among them stays, without
    anything to recover.
    ``contents`` (volume_id, meta_addr, content) adds digests and the type;
    both are skipped above ``max_hash_size``. ``digests`` stand for contents that
    were read in pieces: volume_id, meta_addr, md5, sha1, sha256, hash_skipped,
    head (the first bytes, NULL if there are none).
    """
    facts = tiers.select(
        "volume_id",
        "meta_addr",
        "size",
        "meta_type",
        "confidence_tier",
        "tier_reason",
        "tier_caveat",
        "overlapping_blocks",
    )
    rows = deleted.join(facts, ["volume_id", "meta_addr"], "left").withColumns(
        {
            "tier_reason": F.when(F.col("confidence_tier").isNull(), REASON_NO_INODE).otherwise(F.col("tier_reason")),
            "confidence_tier": F.coalesce("confidence_tier", F.lit(OVERWRITTEN)),
            "meta_type": F.coalesce("meta_type", F.lit("unknown")),
        }
    )
    inode = ["volume_id", "meta_addr"]
    if digests is not None:
        told = digests.select(*inode, *hashes.ALGORITHMS, "hash_skipped", F.col("head").alias("_head"))
        rows = rows.join(told, inode, "left")
        some = F.col("_head").isNotNull() & (F.col("size") > 0)
        rows = rows.withColumns(
            {
                "hash_skipped": F.when(some, F.col("hash_skipped")),
                "file_type": F.when(some & ~F.col("hash_skipped").eqNullSafe(TOO_BIG), signatures.file_type(F.col("_head"))),
                **{a: F.when(some, F.col(a)) for a in hashes.ALGORITHMS},
            }
        )
    else:
        if contents is None:
            rows = rows.withColumn("content", F.lit(None).cast("binary"))
        else:
            rows = rows.join(contents.select(*inode, "content"), inode, "left")
        readable = F.col("content").isNotNull() & (F.col("size") > 0)
        too_big = F.lit(False) if max_hash_size is None else F.col("size") > max_hash_size
        whole = F.octet_length("content") == F.col("size")
        rows = rows.withColumns(
            {
                "hash_skipped": F.when(readable, F.when(too_big, TOO_BIG).when(~whole, "short_read")),
                "file_type": F.when(readable & ~too_big, signatures.file_type(F.col("content"))),
            }
        )
        hashable = readable & F.col("hash_skipped").isNull()
        rows = rows.withColumns({a: F.when(hashable, hashes.digest(F.col("content"), a)) for a in hashes.ALGORITHMS})
    rationale = attributes.flags_json(
        hash_skipped=F.col("hash_skipped"),
        tier_reason=F.col("tier_reason"),
        tier_caveat=F.col("tier_caveat"),
        overlapping_blocks=F.col("overlapping_blocks"),
    )
    values = {
        "evidence_source_id": F.lit(evidence_source_id).cast("long"),
        "file_id": recovered_file_id(F.col("volume_id"), F.col("meta_addr")),
        "allocated": F.lit(False),
        "recovered": F.lit(True),
        "recovered_path": names.recovered_path(
            F.col("volume_id"), F.col("volume_offset"), F.col("meta_addr"), F.col("name")
        ),
        "attributes": rationale,
    }
    columns = []
    for field in FILES.fields:
        if field.name in values:
            columns.append(values[field.name].alias(field.name))
        elif field.name in rows.columns:
            columns.append(F.col(field.name))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    return rows.select(*columns)
