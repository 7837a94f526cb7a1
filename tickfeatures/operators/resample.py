"""A1: resample irregular ticks into fixed buckets (mean price per series and bucket)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import bucket_start, epoch_seconds


def resample(ticks: DataFrame, interval_min: int, keys: Sequence[str] = ("zone", "instance")) -> DataFrame:
    """Mean price per (series, bucket start) for one interval.

    A plain hash aggregate: Spark combines ticks map-side before the shuffle,
    so a series holding most of the ticks sends only one partial row per
    bucket and task. Buckets without ticks produce no row (nothing is filled).
    """
    e = epoch_seconds("ts")
    return (
        ticks.where(F.col("ts").isNotNull())
        .groupBy(*keys, bucket_start(e, interval_min).alias("bucket_epoch"))
        .agg(F.avg("spot_price").alias("spot_price"))
    )


def resample_many(ticks: DataFrame, intervals: Sequence[int], keys: Sequence[str] = ("zone", "instance")) -> DataFrame:
    """All intervals from one scan of the ticks: ``interval_min`` becomes a key column.

    Ticks are aggregated once, to (sum, count) per bucket of the intervals' greatest common
    divisor; only these few rows are copied per interval and rolled up. A mean is the sum of
    the sums by the sum of the counts, so the result is the same mean.
    """
    for i in intervals:
        if i <= 0 or 60 % i:
            raise ValueError(f"interval must divide 60 minutes, got {i}")
    if len(set(intervals)) == 1:
        return resample(ticks, intervals[0], keys).select(F.lit(int(intervals[0])).alias("interval_min"), *keys, "bucket_epoch", "spot_price")
    fine = (
        ticks.where(F.col("ts").isNotNull())
        .groupBy(*keys, bucket_start(epoch_seconds("ts"), math.gcd(*intervals)).alias("_fine"))
        .agg(F.sum("spot_price").alias("_sum"), F.count("spot_price").alias("_n"))
    )
    copies = fine.select(F.explode(F.array(*[F.lit(int(i)) for i in sorted(set(intervals))])).alias("interval_min"), *keys, "_fine", "_sum", "_n")
    start = F.col("_fine") - F.pmod(F.col("_fine"), F.col("interval_min") * 60)
    # each fine bucket has its place in the coarse one, and the places are added in order: the
    # order in which rows arrive does not change the last bits of a mean
    fine_minutes = math.gcd(*intervals)
    place = ((F.col("_fine") - start) / (60 * fine_minutes)).cast("int")
    places = [F.max(F.when(place == k, F.col("_sum"))) for k in range(max(intervals) // fine_minutes)]
    total = reduce(lambda x, y: x + y, [F.coalesce(p, F.lit(0.0)) for p in places])
    return (
        copies.groupBy("interval_min", *keys, start.cast("long").alias("bucket_epoch"))
        .agg(F.try_divide(total, F.sum("_n")).alias("spot_price"))
    )
