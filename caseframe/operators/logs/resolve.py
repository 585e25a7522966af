"""Host zones, seed years, and record times with their provenance flags."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.functions import attributes, syslog, times
from caseframe.operators.logs import discover, years
from caseframe.operators.ordered import bind

# Flag texts.
SEED_MEMBER = "file mtime + rotation order"
SEED_NEWEST = "newest mtime in log set (member mtime absent)"
SEED_NONE = "year unresolved (no mtime on image); anchored to epoch, FLAGGED"
ASSUMED_UTC_WARNING = "WARNING: host timezone undeterminable; assumed UTC"
YEAR_UNRESOLVED_BASIS = (
    "year unresolved (no mtime on image); sorted to end of timeline, NOT genuine chronology"
)
NO_TIME_BASIS = (
    "no per-line timestamp and no mtime on image; sorted to end of timeline, NOT genuine chronology"
)
IMPOSSIBLE_DATE_BASIS = "impossible calendar date; sorted to end of timeline, NOT genuine chronology"

EPOCH_YEAR = 1970


def zone_names(spark: SparkSession) -> list[str]:
    """Zone names that time conversion takes: a name it does not know would end the job."""
    known = spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds()
    return sorted(available_timezones() & {z for z in known})


def host_zones(config_files: DataFrame, valid_names: list[str] | None = None) -> DataFrame:
    """One row per volume: zone (NULL if undeterminable) and tz_resolution.

    ``config_files``: volume_id, path, link_target, text; only the two zone
    files of a volume are looked at.
    """
    valid = sorted(valid_names) if valid_names is not None else zone_names(config_files.sparkSession)
    known = F.array(*[F.lit(z) for z in valid])
    trim = r"(?U)^\s+|\s+$"
    target, text = F.col("link_target"), F.col("text")
    linked = F.regexp_replace(
        F.when(F.contains(target, F.lit("/zoneinfo/")), F.regexp_replace(target, "^.*?/zoneinfo/", "")).otherwise(
            F.regexp_replace(target, "^/+", "")
        ),
        trim,
        "",
    )
    first_line = F.regexp_replace(
        F.get(F.split(F.regexp_replace(text, trim, ""), "\\R", 2), 0), trim, ""
    )
    by_volume = config_files.groupBy("volume_id").agg(
        F.max(F.when(F.col("path") == "/etc/localtime", linked)).alias("_link"),
        F.max(F.when(F.col("path") == "/etc/timezone", first_line)).alias("_text"),
    )
    link_ok = F.coalesce(F.array_contains(known, F.col("_link")), F.lit(False))
    text_ok = F.coalesce(F.array_contains(known, F.col("_text")), F.lit(False))
    return by_volume.select(
        "volume_id",
        F.when(link_ok, F.col("_link")).when(text_ok, F.col("_text")).alias("zone"),
        F.when(link_ok, "etc-localtime")
        .when(text_ok, "etc-timezone")
        .otherwise("tz-undeterminable")
        .alias("tz_resolution"),
    )


def seed_years(members: DataFrame, file_times: DataFrame) -> DataFrame:
    """Seed year per member: its own mtime, else the newest of the volume, else 1970.

    ``file_times``: volume_id, path, mtime (epoch seconds, 0 or NULL = none).
    They are cut down to the member paths before they are grouped by path.
    """
    wanted = members.select("volume_id", "path").distinct()
    own = file_times.join(wanted, ["volume_id", "path"], "left_semi").groupBy("volume_id", "path").agg(F.max("mtime").alias("_own"))
    newest = file_times.groupBy("volume_id").agg(F.max(F.coalesce(F.col("mtime"), F.lit(0))).alias("_newest"))
    rows = members.join(own, ["volume_id", "path"], "left").join(newest, ["volume_id"], "left")

    def year_of(secs: Column) -> Column:
        return F.year(times.epoch_to_utc(secs))

    own_ok = F.coalesce(F.col("_own"), F.lit(0)) != 0
    newest_ok = F.coalesce(F.col("_newest"), F.lit(0)) != 0
    return (
        rows.withColumn(
            "seed_year",
            F.when(own_ok, year_of(F.col("_own")))
            .when(newest_ok, year_of(F.col("_newest")))
            .otherwise(EPOCH_YEAR)
            .cast("int"),
        )
        .withColumn(
            "seed_basis",
            F.when(own_ok, SEED_MEMBER).when(newest_ok, SEED_NEWEST).otherwise(SEED_NONE),
        )
        .withColumn("seed_unresolved", ~own_ok & ~newest_ok)
        .drop("_own", "_newest")
    )


def with_components(records: DataFrame) -> DataFrame:
    """Add month..second of the year-less head; epoch records have none."""
    head = F.when(F.col("epoch").isNull(), F.col("raw_timestamp"))
    split = bind(records, "_head_time", syslog.head_time_parts(head))
    fields = syslog.head_time_fields(F.col("_head_time"))
    return split.select(*records.columns, *[c.alias(n) for n, c in fields.items()])


def resolve(
    records: DataFrame,
    members: DataFrame,
    strict_rfc5424: bool = False,
    segment_rows: int = years.SEGMENT,
    scope: str = "member",
) -> DataFrame:
    """Date every record.

    ``members`` has one row per (volume_id, path): evidence_source_id,
    volume_offset, file_id, seed_year, seed_basis, seed_unresolved, zone,
    tz_resolution. Adds ts_utc, is_undated and the flag columns.

    Years are inferred per member, each from its own seed, or with
    ``scope="set"`` over the whole rotated set from the seed of its newest
    member.

    Precedence: embedded epoch, offset-carrying head (unless ``strict_rfc5424``),
    year-less head, January 1 of the seed year, undated.
    """
    headed = with_components(records)
    if scope == "member":
        rows = years.infer(headed, ["volume_id", "path"], ["line_ord", "line_sub"], members, segment_rows)
    elif scope == "set":
        place = {"_set": discover.set_of_path(F.col("path")), **discover.place_of_path(F.col("path"))}
        majors = ["_place", "_plain", "path"]
        placed = members.withColumns(place)
        newest = placed.groupBy("volume_id", "_set").agg(
            F.max_by("seed_year", F.struct(*majors)).alias("_seed")
        )
        seeded = placed.join(newest, ["volume_id", "_set"]).withColumn("seed_year", F.col("_seed"))
        rows = years.infer(
            headed.withColumns(place),
            ["volume_id", "_set"],
            ["line_ord", "line_sub"],
            seeded.drop("_seed"),
            segment_rows,
            majors,
        )
    else:
        raise ValueError(f"unknown scope {scope!r}")
    zone, way = F.col("zone"), F.col("_way")
    unresolved = F.col("seed_unresolved")
    offset_head = F.col("raw_timestamp").rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$")
    in_clock = F.col("hour").between(0, 23) & F.col("minute").between(0, 59) & F.col("second").between(0, 59)
    wall = F.try_make_timestamp(
        F.col("year"), F.col("month"), F.col("day"), F.col("hour"), F.col("minute"), F.col("second")
    )
    new_year = F.make_timestamp(F.col("seed_year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    offset_ts = F.col("raw_timestamp").try_cast("timestamp")
    staged = rows.withColumn(
        "_offset_ts",
        F.lit(None).cast("timestamp")
        if strict_rfc5424
        else F.when(F.col("is_rfc5424") & offset_head, offset_ts),
    ).withColumn(
        "_way",
        F.when(F.col("epoch").isNotNull(), "epoch")
        .when(F.col("_offset_ts").isNotNull(), "offset")
        .when(F.col("month").isNotNull(), "head")
        .otherwise("fallback"),
    )
    # The instant the line itself gives; NULL for an impossible date.
    staged = staged.withColumn(
        "_given",
        F.when(way == "epoch", times.epoch_to_utc(F.col("epoch")))
        .when(way == "offset", F.col("_offset_ts"))
        .otherwise(
            times.wallclock_utc(
                F.when(way == "fallback", new_year).when(in_clock & F.col("year").between(1, 9999), wall), zone
            )
        ),
    )
    guessed = way.isin("head", "fallback")
    staged = staged.withColumns(
        {
            "_dated": F.when(~(guessed & unresolved), F.col("_given")),
            "_zoned": F.col("_given").isNotNull() & ((way == "head") | ((way == "fallback") & ~unresolved)),
        }
    )
    zoned = F.col("_zoned")
    return staged.select(
        *records.columns,
        "evidence_source_id",
        "volume_offset",
        "file_id",
        F.coalesce(F.col("_dated"), times.undated_instant()).alias("ts_utc"),
        F.col("_dated").isNull().alias("is_undated"),
        F.when(way == "epoch", "log:embedded-epoch")
        .when(way == "offset", "log:rfc5424-offset")
        .when(zoned, F.when(zone.isNotNull(), "log:inferred-tz").otherwise("log:assumed-utc"))
        .alias("timestamp_source"),
        F.when(zoned, zone).alias("assumed_timezone"),
        F.when(zoned & zone.isNull(), ASSUMED_UTC_WARNING).alias("time_warning"),
        F.when(way == "head", F.col("year")).alias("year_inferred"),
        F.when(guessed, F.col("seed_basis")).alias("year_basis"),
        F.when(F.col("_given").isNull(), IMPOSSIBLE_DATE_BASIS)
        .when(way == "head", F.when(unresolved, YEAR_UNRESOLVED_BASIS))
        .when(way == "fallback", F.when(unresolved, NO_TIME_BASIS).otherwise(syslog.NO_TIMESTAMP_BASIS))
        .alias("resolved_basis"),
        F.when((way == "head") & unresolved, times.iso_utc(F.col("_given"))).alias("ts_resolved"),
        "tz_resolution",
    )


def to_events(resolved: DataFrame) -> DataFrame:
    """Dated records in the shape of the timeline table."""
    flags = attributes.flags_json(
        raw=F.col("raw"),
        rfc5424=F.col("is_rfc5424"),
        kind=F.col("kind"),
        ts_basis=F.col("resolved_basis"),
        ts_resolved=F.col("ts_resolved"),
        timestamp_source=F.col("timestamp_source"),
        assumed_timezone=F.col("assumed_timezone"),
        time_warning=F.col("time_warning"),
        year_inferred=F.col("year_inferred"),
        year_basis=F.col("year_basis"),
        tz_resolution=F.col("tz_resolution"),
    )
    return resolved.select(
        "evidence_source_id",
        "file_id",
        "ts_utc",
        "is_undated",
        F.col("parser").alias("source"),
        F.coalesce(F.col("action"), F.lit("log")).alias("event_type"),
        "volume_id",
        "volume_offset",
        "path",
        F.lit(None).cast("long").alias("meta_addr"),
        F.nullif(F.col("actor"), F.lit("")).alias("actor"),
        "action",
        "outcome",
        "line_ord",
        "line_sub",
        attributes.merged(F.col("extra"), flags).alias("attributes"),
    )
