"""Column expressions: bucket arithmetic, calendar flags, caps, labels, check rounding."""

from .calendar import calendar_flags
from .check import stable_round
from .labels import current_direction, direction_class, direction_flags, volatility_flag
from .pricing import caps_frame, irrational_flag, region_of, uncovered_series, with_price_cap
from .time import (
    bucket_start,
    date_of,
    epoch_seconds,
    hour_of,
    iso_day_of_week,
    legacy_bucket_key,
    slot_in_hour,
    timestamp_of,
    unix_day,
)

__all__ = [
    "bucket_start", "calendar_flags", "caps_frame", "current_direction", "date_of", "direction_class",
    "direction_flags", "epoch_seconds", "hour_of", "irrational_flag", "iso_day_of_week", "legacy_bucket_key", "region_of",
    "slot_in_hour", "stable_round", "timestamp_of", "uncovered_series", "unix_day", "volatility_flag",
    "with_price_cap",
]
