"""Epochs and wall clocks to UTC instants, and the ISO text used at the report edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of 0001-01-01T00:00:00Z and 9999-12-31T23:59:59Z.
MIN_EPOCH = -62135596800
MAX_EPOCH = 253402300799

# Sorts after every dated event.
UNDATED = "9999-12-31 23:59:59"


def undated_instant() -> Column:
    return F.lit(UNDATED).cast("timestamp")


def epoch_in_range(secs: Column) -> Column:
    return secs.between(F.lit(MIN_EPOCH), F.lit(MAX_EPOCH))


def epoch_to_utc(secs: Column) -> Column:
    """UTC instant of an epoch; NULL outside year 1..9999."""
    return F.when(epoch_in_range(secs), F.timestamp_seconds(secs))


def macb_utc(secs: Column, nanos: Column, is_fat: Column, zone: Column | str) -> Column:
    """One MACB stamp in UTC; 0 and out-of-range epochs are NULL.

    FAT stamps are wall-clock readings stored as if they were UTC, so they are
    re-read in ``zone``. Sub-second nanoseconds are cut to microseconds.
    """
    micros = F.floor(F.coalesce(nanos, F.lit(0)) / F.lit(1000)).cast("long")
    base = F.timestamp_seconds(secs)
    rebased = F.when(is_fat, F.to_utc_timestamp(base, zone)).otherwise(base)
    return F.when(
        (secs != 0) & epoch_in_range(secs),
        F.timestamp_micros(F.unix_micros(rebased) + micros),
    )


def wallclock_utc(wall: Column, zone: Column) -> Column:
    """Instant of a zone-less wall clock; an unknown zone reads as UTC."""
    return F.to_utc_timestamp(wall, F.coalesce(zone, F.lit("UTC")))


def _pick(texts: list[str], at: Column) -> Column:
    """``texts[at]``; the split of a literal is done once, when the plan is made."""
    return F.get(F.split(F.lit(",".join(texts)), ","), at.cast("int"))


_MONTH_DAY = [f"-{month:02d}-{day:02d}T" for month in range(1, 13) for day in range(1, 32)]
_HOUR_MINUTE = [f"{hour:02d}:{minute:02d}:" for hour in range(24) for minute in range(60)]
_SECOND = [f"{second:02d}" for second in range(60)]
_MILLI = [f".{n:03d}" for n in range(1000)]
_MICRO = [f"{n:03d}+00:00" for n in range(1000)]


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with ``+00:00``; microseconds only when non-zero.

    The pieces are looked up, as a formatter costs more than all else that a row of a listing needs.
    """
    date, second = F.to_date(ts), F.pmod(F.unix_seconds(ts), F.lit(86400)).cast("int")
    micros = F.pmod(F.unix_micros(ts), F.lit(1000000)).cast("int")
    year = F.year(date)
    four = year.cast("string")
    whole = micros == 0
    picked = F.concat(
        F.when(year >= 1000, four).otherwise(F.lpad(four, 4, "0")),
        _pick(_MONTH_DAY, F.month(date) * 31 + F.dayofmonth(date) - 32),
        _pick(_HOUR_MINUTE, F.floor(second / 60)),
        _pick(_SECOND, second % 60),
        F.when(whole, "").otherwise(_pick(_MILLI, F.floor(micros / 1000))),
        F.when(whole, "+00:00").otherwise(_pick(_MICRO, micros % 1000)),
    )
    return F.when(year.between(1, 9999), picked).otherwise(_formatted(ts, micros))


def _formatted(ts: Column, micros: Column) -> Column:
    fraction = F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))
