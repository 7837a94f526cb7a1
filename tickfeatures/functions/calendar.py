"""Calendar flags of a bucket (hour windows, ISO weekday)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inclusive hour windows of the work-time flags and the last
# hour counted as night.
WORK_WINDOWS = {"is_work_6_18": (6, 18), "is_work_9_17": (9, 17), "is_work_8_18": (8, 18)}
NIGHT_LAST_HOUR = 6
LAST_WEEKDAY = 5


def calendar_flags(hour: str | Column = "hour", iso_dow: str | Column = "iso_dow") -> dict[str, Column]:
    """0/1 int flags: weekday, three work-time windows and night."""
    h = F.col(hour) if isinstance(hour, str) else hour
    d = F.col(iso_dow) if isinstance(iso_dow, str) else iso_dow
    flags = {"is_weekday": (d <= LAST_WEEKDAY).cast("int")}
    for name, (lo, hi) in WORK_WINDOWS.items():
        flags[name] = h.between(lo, hi).cast("int")
    flags["is_night"] = (h <= NIGHT_LAST_HOUR).cast("int")
    return flags
