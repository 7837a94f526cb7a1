"""On-demand price caps as a dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CAPS, PRICE_CAPS


def region_of(zone: str | Column) -> Column:
    """Region of an availability zone: the zone name without its last letter."""
    z = F.col(zone) if isinstance(zone, str) else zone
    return F.substring(z, F.lit(1), F.length(z) - 1)


def caps_frame(spark: SparkSession, rows=PRICE_CAPS) -> DataFrame:
    """The cap table (9 rows by default): region, instance, cap."""
    return spark.createDataFrame(list(rows), CAPS)


def with_price_cap(df: DataFrame, caps: DataFrame, zone: str = "zone", instance: str = "instance") -> DataFrame:
    """Left-join the cap of each row's (region, instance); unknown keys get a null cap.

    The cap table is a fixed dimension of a handful of rows, so it is broadcast
    and the big side is never shuffled for this join.
    """
    c = caps.select(F.col("region").alias("_cap_region"), F.col("instance").alias("_cap_instance"), "cap")
    cond = (region_of(zone) == F.col("_cap_region")) & (F.col(instance) == F.col("_cap_instance"))
    return df.join(F.broadcast(c), cond, "left").drop("_cap_region", "_cap_instance")


def irrational_flag(price: str | Column = "spot_price", cap: str | Column = "cap") -> Column:
    """1 when the spot price is at or above the on-demand cap; null when either is unknown."""
    p = F.col(price) if isinstance(price, str) else price
    c = F.col(cap) if isinstance(cap, str) else cap
    return (p >= c).cast("int")


def uncovered_series(df: DataFrame, caps: DataFrame, zone: str = "zone", instance: str = "instance") -> DataFrame:
    """Distinct (zone, instance) pairs that have no cap (left anti join)."""
    keys = df.select(F.col(zone).alias("zone"), F.col(instance).alias("instance")).distinct()
    c = caps.select(F.col("region").alias("_cap_region"), F.col("instance").alias("_cap_instance"))
    cond = (region_of("zone") == F.col("_cap_region")) & (F.col("instance") == F.col("_cap_instance"))
    return keys.join(F.broadcast(c), cond, "left_anti")
