"""Feature tables stored by series: one folder per (interval, zone, instance).

A search over one series lists and reads that series' folder only; the series themselves
are found from the folders' names, without reading a row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FEATURES
from .tables import FEATURES_WITH_INTERVAL

SERIES_FOLDERS = ("interval_min", "zone", "instance")


def write_series_store(tables: Mapping[int, DataFrame], path: str) -> None:
    """Store the tables (interval -> rows). Only the series in them are replaced; rows are dealt
    by hash of (interval, series, month), so a long series is written by several tasks."""
    both = None
    for interval, table in tables.items():
        one = table.withColumn("interval_min", F.lit(interval))
        both = one if both is None else both.unionByName(one)
    if both is None:
        raise ValueError("no tables")
    dealt = both.repartition(*SERIES_FOLDERS, F.trunc("date", "month"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SERIES_FOLDERS).parquet(path)


def read_series_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURES_WITH_INTERVAL).parquet(path)


def stored_series(spark: SparkSession, path: str) -> DataFrame:
    """``interval_min, zone, instance`` of the store; read from its folders."""
    return read_series_store(spark, path).select(*SERIES_FOLDERS).distinct()


def read_series(spark: SparkSession, path: str, interval: int, zone: str, instance: str) -> DataFrame:
    """One series' rows; the conditions prune all other folders."""
    found = read_series_store(spark, path)
    return found.where((F.col("interval_min") == interval) & (F.col("zone") == zone) & (F.col("instance") == instance)).select(*FEATURES.fieldNames())
