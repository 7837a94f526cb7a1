"""C1 / IO6: the feature-table builder (ticks -> 36-column feature table)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import calendar_flags
from ..functions.labels import direction_class, direction_flags, volatility_flag
from ..functions.pricing import caps_frame, irrational_flag, with_price_cap
from ..functions.time import date_of, hour_of, iso_day_of_week, slot_in_hour, timestamp_of
from ..operators.daily import join_previous_day, previous_day_by_range
from ..operators.resample import resample_many
from ..operators.sequence import shift_columns
from ..schemas import EPSILON, FEATURE_COLUMNS, SERIES_KEYS

LAGS = {"lag_1": ("spot_price", -1), "lag_2": ("spot_price", -2), "lag_3": ("spot_price", -3)}
SERIES_WINDOW_KEYS = ("interval_min", *SERIES_KEYS)
LEADS = {
    "y_increase": ("inc_t", 1),
    "y_decrease": ("dec_t", 1),
    "y_same": ("same_t", 1),
    "y_future_price": ("spot_price", 1),
}


def bucket_table(ticks: DataFrame, intervals: Sequence[int], caps: DataFrame | None = None) -> DataFrame:
    """Resampled rows with calendar and price-cap columns (before any window)."""
    caps = caps if caps is not None else caps_frame(ticks.sparkSession)
    base = with_price_cap(resample_many(ticks, intervals, SERIES_KEYS), caps)
    e = F.col("bucket_epoch")
    hour, dow = hour_of(e), iso_day_of_week(e)
    cols = {
        "date": date_of(e),
        "bucket_ts": timestamp_of(e),
        "hour": hour,
        "slot": slot_in_hour(e, F.col("interval_min")),
        "iso_dow": dow,
        **calendar_flags(hour, dow),
        "is_irrational": irrational_flag(),
    }
    # one projection (each DataFrame step costs a round of analysis on the driver)
    return base.select(*[c for c in base.columns if c != "cap"], *[v.alias(k) for k, v in cols.items()])


def add_lags(df: DataFrame, mode: str = "series") -> DataFrame:
    """Previous three observed prices of each series."""
    return shift_columns(df, SERIES_WINDOW_KEYS, "bucket_epoch", LAGS, mode=mode)


def changes_and_flags(df: DataFrame, eps: float = EPSILON) -> DataFrame:
    """Drop rows without three lags, then price changes and direction flags."""
    df = df.dropna(subset=["spot_price", "lag_1", "lag_2", "lag_3"])
    change = F.col("spot_price") - F.col("lag_1")
    return df.withColumns({
        "price_change": change,
        "price_change_lag1": F.col("lag_1") - F.col("lag_2"),
        "price_change_lag2": F.col("lag_2") - F.col("lag_3"),
        **direction_flags(change, eps),
    })


def with_lags(df: DataFrame, eps: float = EPSILON, mode: str = "series") -> DataFrame:
    """Lags, drop of each series' first three rows, changes and direction flags."""
    return changes_and_flags(add_lags(df, mode), eps)


def with_leads(df: DataFrame, mode: str = "series") -> DataFrame:
    """Next-step labels, then drop of each series' last row."""
    df = shift_columns(df, SERIES_WINDOW_KEYS, "bucket_epoch", LEADS, mode=mode)
    flags = {c: F.col(c).cast("double") for c in ("y_increase", "y_decrease", "y_same")}
    direction = direction_class(flags["y_increase"], flags["y_same"], flags["y_decrease"]).cast("double")
    df = df.withColumns({**flags, "y_direction": direction})
    return df.dropna(subset=["y_increase", "y_decrease", "y_same", "y_future_price"])


def _mean_deviation(rows: DataFrame) -> DataFrame:
    """The mean previous-day deviation over all rows, per interval, from one row per series
    and day: each day's deviation weighs as many rows as the next day has."""
    daily = rows.groupBy(*SERIES_WINDOW_KEYS, "date").agg(F.stddev_samp("price_change").alias("_s"), F.count(F.lit(1)).alias("_n"))
    after = Window.partitionBy(*SERIES_WINDOW_KEYS).orderBy(F.unix_date("date")).rangeBetween(1, 1)
    weighed = daily.withColumn("_w", F.sum("_n").over(after)).where("_w is not null and _s is not null and not isnan(_s)")
    return weighed.groupBy("interval_min").agg((F.sum(F.col("_s") * F.col("_w")) / F.sum("_w")).alias("_fill"))


def with_previous_day(df: DataFrame, how: str = "window") -> DataFrame:
    """Previous-day statistics, mean differences, std fill, volatility.

    ``how="window"`` (default) takes the statistics from a range window over the
    day number that shares the lag/lead shuffle; ``how="join"`` aggregates a
    daily table and inner-joins it back (the reference's formulation). Both drop
    rows whose previous day is empty; values agree to ~1e-14 (summation order).
    """
    rows = df
    if how == "window":
        df = previous_day_by_range(df, SERIES_WINDOW_KEYS)
    elif how == "join":
        df = join_previous_day(df, SERIES_WINDOW_KEYS)
    else:
        raise ValueError(f"unknown previous-day form {how!r}")
    # null/NaN std -> mean std of the interval (one row per interval, broadcast)
    raw_std = F.when(~F.isnan("prev_day_std_change"), F.col("prev_day_std_change"))
    means = _mean_deviation(rows)
    df = df.join(F.broadcast(means), ["interval_min"], "left")
    std = F.coalesce(raw_std, F.col("_fill"))

    def zero_fill(c: str):  # P15: fillna(0.0) semantics (null or NaN -> 0.0)
        return F.nanvl(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))

    return df.withColumns({
        "diff_mean_price": F.col("spot_price") - F.col("prev_day_avg_price"),
        "abs_diff_mean_change": F.abs(F.col("price_change") - F.col("prev_day_avg_change")),
        "prev_day_std_change": std,
        "is_volatile": volatility_flag("price_change", std),
        "price_change": zero_fill("price_change"),
        "y_future_price": zero_fill("y_future_price"),
    }).drop("_fill")


def build_features_all(
    ticks: DataFrame,
    intervals: Sequence[int],
    eps: float = EPSILON,
    caps: DataFrame | None = None,
    mode: str = "series",
    prev_day: str | None = None,
) -> DataFrame:
    """Feature tables of several intervals from one scan: ``interval_min`` + the 36 columns.

    ``mode="series"`` windows over whole series (bounded by the bucket grid) and
    takes the previous day from a range window on the same shuffle.
    ``mode="chunked"`` runs no window over all rows of a series: lags/leads per
    block of positions with a halo (only the running count of earlier days spans
    a series, over one row per day), previous-day statistics by a join on
    (series, date).
    ``prev_day`` ("window" / "join") overrides the previous-day form.
    """
    how = prev_day or ("join" if mode == "chunked" else "window")
    df = bucket_table(ticks, intervals, caps)
    df = with_lags(df, eps, mode)
    df = with_leads(df, mode)
    df = with_previous_day(df, how)
    return df.select("interval_min", *FEATURE_COLUMNS)


def build_features(
    ticks: DataFrame,
    interval: int = 60,
    eps: float = EPSILON,
    caps: DataFrame | None = None,
    mode: str = "series",
    prev_day: str | None = None,
) -> DataFrame:
    """The 36-column feature table of one interval (lazy: no action is run)."""
    return build_features_all(ticks, [interval], eps, caps, mode, prev_day).drop("interval_min")
