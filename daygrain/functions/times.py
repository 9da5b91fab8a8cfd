"""Local days, solar hours and wall clocks. Instants are epoch seconds (long)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S = 86_400


def epoch(ts: Column) -> Column:
    """Epoch seconds of a timestamp, with or without a zone, read as UTC."""
    return F.unix_timestamp(ts.cast("timestamp"))


def wall_to_epoch(wall: Column, tz: Column) -> Column:
    """Epoch seconds of a wall-clock time in an IANA zone; null where either is null."""
    return F.unix_timestamp(F.to_utc_timestamp(wall.cast("timestamp"), tz))


def offset_s(at: Column, tz: Column) -> Column:
    """Seconds that a zone is ahead of UTC at an instant."""
    utc = F.timestamp_seconds(at)
    return F.unix_timestamp(F.from_utc_timestamp(utc, tz)) - at


def local_day(date: Column, tz: Column, exact: bool = False) -> Column:
    """struct<start, end> of a local date.

    As a rule the start is UTC midnight less the whole hours of the offset at that midnight, and the day has 24 hours; `exact` gives
    the true bounds, of 23 or 25 hours where clocks change."""
    midnight = F.unix_timestamp(date.cast("date").cast("timestamp"))
    if exact:
        return F.struct(wall_to_epoch(date, tz).alias("start"), wall_to_epoch(F.date_add(date.cast("date"), 1), tz).alias("end"))
    hours = F.expr("0") + F.floor(F.abs(offset_s(midnight, tz)) / 3600) * F.signum(offset_s(midnight, tz)).cast("long")
    start = midnight - hours * 3600
    return F.struct(start.alias("start"), (start + DAY_S).alias("end"))


def solar_seconds(t: Column, lon: Column) -> Column:
    """Local solar time of an instant, in seconds since the epoch: one hour for each 15 degrees of longitude."""
    return t + lon / 15.0 * 3600


def solar_hour(t: Column, lon: Column) -> Column:
    return F.pmod(F.floor(solar_seconds(t, lon) / 3600), F.lit(24)).cast("int")


def solar_hour_fraction(t: Column, lon: Column) -> Column:
    return F.pmod(solar_seconds(t, lon), F.lit(float(DAY_S))) / 3600


def solar_weekday(t: Column, lon: Column) -> Column:
    """0 for Sunday; the first day of the epoch was a Thursday."""
    return F.pmod(F.floor(solar_seconds(t, lon) / DAY_S) + 4, F.lit(7)).cast("int")


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    k = 10**digits
    return F.floor(x * k + 0.5) / k
