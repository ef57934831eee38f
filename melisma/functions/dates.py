"""Date and time functions (DT-*). The present is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_of_text(s: Column) -> Column:
    """The year of YYYY or YYYY-MM-DD; null if it is none."""
    return F.substring_index(s, "-", 1).try_cast("int")


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("long")


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def seconds_apart(a: Column, b: Column) -> Column:
    return F.abs(F.unix_seconds(a.cast("timestamp")) - F.unix_seconds(b.cast("timestamp")))


def age_hours(then: Column, now: Column) -> Column:
    return F.timestamp_diff("HOUR", then, now)


def stale(then: Column, now: Column, days: int = 30) -> Column:
    """Never, or longer ago than that."""
    return then.isNull() | (then < now - F.expr(f"INTERVAL {days} DAYS"))


def compact_stamp(t: Column) -> Column:
    return F.date_format(t, "yyyyMMdd_HHmmss")


def iso_stamp(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def short_stamp(t: Column) -> Column:
    return F.date_format(t, "dd/MM/yyyy, HH:mm")
