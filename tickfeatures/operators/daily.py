"""Statistics of the previous calendar day, joined onto each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PREV_DAY_COLUMNS = (
    "prev_day_avg_price",
    "prev_day_max_price",
    "prev_day_min_price",
    "prev_day_avg_change",
    "prev_day_max_change",
    "prev_day_min_change",
    "prev_day_std_change",
)


def _day_aggregates(price: str = "spot_price", change: str = "price_change") -> dict:
    return {
        "prev_day_avg_price": F.avg(price),
        "prev_day_max_price": F.max(price),
        "prev_day_min_price": F.min(price),
        "prev_day_avg_change": F.avg(change),
        "prev_day_max_change": F.max(change),
        "prev_day_min_change": F.min(change),
        "prev_day_std_change": F.stddev_samp(change),
    }


def daily_stats(df: DataFrame, keys: Sequence[str] = ("zone", "instance"), price: str = "spot_price",
                change: str = "price_change") -> DataFrame:
    """A2: per (series, date) avg/max/min price and avg/max/min/sample-stddev change."""
    return df.groupBy(*keys, "date").agg(*[c.alias(n) for n, c in _day_aggregates(price, change).items()])


def shift_days(daily: DataFrame, days: int = 1) -> DataFrame:
    """move each day's statistics onto the following day."""
    return daily.withColumn("date", F.date_add("date", days))


def join_previous_day(df: DataFrame, keys: Sequence[str] = ("zone", "instance")) -> DataFrame:
    """Inner join of each row with its series' statistics of the previous day.

    Rows whose previous calendar day has no rows vanish. The daily table has one
    row per series-day, so join keys are (series, date): no key holds more
    than one day of buckets, whatever the skew between series. AQE turns the
    join into a broadcast one at run time when the measured daily side is small.
    """
    daily = shift_days(daily_stats(df, keys))
    return df.join(daily, [*keys, "date"], "inner")


def previous_day_by_range(df: DataFrame, keys: Sequence[str] = ("zone", "instance")) -> DataFrame:
    """J1, window form: the same statistics over ``RANGE 1 PRECEDING AND 1 PRECEDING`` days.

    Rows whose previous calendar day has no rows are dropped, as with the inner
    join. The window partitions by series like the lag/lead windows, so it reuses
    their shuffle: no second exchange of the rows and no join. The frame is the
    same for all rows of a day, so each day's statistics are aggregated once.
    """
    w = Window.partitionBy(*keys).orderBy(F.unix_date("date")).rangeBetween(-1, -1)
    aggs = {**_day_aggregates(), "_prev_n": F.count(F.lit(1))}
    out = df.withColumns({n: c.over(w) for n, c in aggs.items()})  # one Window node
    return out.where(F.col("_prev_n") > 0).drop("_prev_n")


def fill_with_mean(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Replace null/NaN in ``column`` with the mean of its non-null values (per ``by`` group).

    Without ``by`` the mean is a scalar subquery; with ``by`` it is a table of one
    row per group (callers pass low-cardinality keys such as the interval), joined
    as a broadcast. Nothing goes through the driver and the plan stays lazy.
    """
    clean = F.when(~F.isnan(column), F.col(column))
    if not by:
        mean = df.agg(F.avg(clean)).scalar()
        return df.withColumn(column, F.coalesce(clean, mean))
    means = df.groupBy(*by).agg(F.avg(clean).alias("_fill"))
    return (
        df.join(F.broadcast(means), list(by), "left")
        .withColumn(column, F.coalesce(clean, F.col("_fill")))
        .drop("_fill")
    )
