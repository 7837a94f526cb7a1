"""Bucket and calendar arithmetic on epoch seconds.

Everything is integer arithmetic on UTC epoch seconds, so results do not depend
on the session time zone and the same formulas hold in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400
SECONDS_PER_HOUR = 3600


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_seconds(ts: str | Column) -> Column:
    """Whole epoch seconds of a timestamp (TIMESTAMP_NTZ is read as UTC wall clock)."""
    return F.unix_timestamp(_c(ts)).cast("long")


def floor_to(epoch: str | Column, seconds: int) -> Column:
    """Largest multiple of ``seconds`` not above ``epoch`` (floor, also before 1970)."""
    e = _c(epoch)
    return (e - F.pmod(e, F.lit(seconds))).cast("long")


def bucket_start(epoch: str | Column, interval_min: int | str | Column) -> Column:
    """Start of the ``interval_min``-minute bucket holding ``epoch``."""
    n = _interval_seconds(interval_min)
    e = _c(epoch)
    return (e - F.pmod(e, n)).cast("long")


def slot_in_hour(bucket_epoch: str | Column, interval_min: int | str | Column) -> Column:
    """1-based position of the bucket inside its hour: 1..60/interval."""
    n = _interval_seconds(interval_min)
    return (F.floor(F.pmod(_c(bucket_epoch), F.lit(SECONDS_PER_HOUR)) / n) + 1).cast("int")


def legacy_bucket_key(bucket_epoch: str | Column, interval_min: int | str | Column) -> Column:
    """The reference's numeric bucket key: hour start + slot minutes (slot = 1..60/interval).

    It groups and orders exactly like ``bucket_epoch``; only the number differs. For
    users who need the old key's values (e.g. to join with tables built by the reference).
    """
    e = _c(bucket_epoch)
    return (e - F.pmod(e, F.lit(SECONDS_PER_HOUR)) + slot_in_hour(e, interval_min) * 60).cast("long")


def unix_day(epoch: str | Column) -> Column:
    """Days since 1970-01-01 (floor)."""
    return F.floor(_c(epoch) / F.lit(SECONDS_PER_DAY)).cast("int")


def date_of(epoch: str | Column) -> Column:
    return F.date_from_unix_date(unix_day(epoch))


def hour_of(epoch: str | Column) -> Column:
    return F.floor(F.pmod(_c(epoch), F.lit(SECONDS_PER_DAY)) / F.lit(SECONDS_PER_HOUR)).cast("int")


def iso_day_of_week(epoch: str | Column) -> Column:
    """ISO day of week, Monday = 1 .. Sunday = 7 (1970-01-01 was a Thursday)."""
    return (F.pmod(unix_day(epoch) + F.lit(3), F.lit(7)) + 1).cast("int")


def timestamp_of(epoch: str | Column) -> Column:
    """UTC wall-clock TIMESTAMP_NTZ of an epoch, independent of the session zone."""
    e = _c(epoch)
    return F.timestamp_add("SECOND", e, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def _interval_seconds(interval_min: int | str | Column) -> Column:
    if isinstance(interval_min, int):
        if interval_min <= 0 or 60 % interval_min:
            raise ValueError(f"interval must divide 60 minutes, got {interval_min}")
        return F.lit(interval_min * 60)
    return _c(interval_min) * 60
