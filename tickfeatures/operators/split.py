"""Reproducible splits and samples.

A row's split bucket is a hash of its key (first 8 hex digits of md5 -> 0..99),
so the split does not change with partitioning, task retries or lost
executors, and other engines can compute the same value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_KEY = ("zone", "instance", "bucket_epoch")


def key_hash(key_cols: Sequence[str] = DEFAULT_KEY) -> Column:
    """First 32 bits of the md5 of the '|'-joined key, as a number."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def hash_bucket(key_cols: Sequence[str] = DEFAULT_KEY) -> Column:
    """0..99 from md5 of the '|'-joined key."""
    return F.pmod(key_hash(key_cols), F.lit(100)).cast("int")


def with_split(df: DataFrame, key_cols: Sequence[str] = DEFAULT_KEY, test_pct: int = 20,
               validation_pct_of_rest: int = 30) -> DataFrame:
    """Nested split (reference: 80/20, then 70/30 of the 80): adds ``part`` in train/validation/test."""
    rest = 100 - test_pct
    train_cut = rest * (100 - validation_pct_of_rest) // 100
    b = hash_bucket(key_cols)
    part = F.when(b < train_cut, "train").when(b < rest, "validation").otherwise("test")
    return df.withColumn("part", part)


def with_two_way_split(df: DataFrame, key_cols: Sequence[str] = DEFAULT_KEY, train_pct: int = 70) -> DataFrame:
    """Single split (reference: 70/30): adds ``part`` in train/test."""
    return df.withColumn("part", F.when(hash_bucket(key_cols) < train_pct, "train").otherwise("test"))


def with_time_split(df: DataFrame, order: str = "bucket_epoch", test_from: int | None = None,
                    validation_from: int | None = None) -> DataFrame:
    """Time-ordered split: rows at or after ``test_from`` are test, etc. (no look-ahead leak)."""
    part = F.lit("train")
    if validation_from is not None:
        part = F.when(F.col(order) >= validation_from, "validation").otherwise(part)
    if test_from is not None:
        part = F.when(F.col(order) >= test_from, "test").otherwise(part)
    return df.withColumn("part", part)


def with_purged_split(df: DataFrame, order: str = "bucket_epoch", series: Sequence[str] = ("zone", "instance"),
                      train_share: float = 0.56, train_validation_share: float = 0.8, before: int = 3, after: int = 1) -> DataFrame:
    """Time-ordered split of each series by its own edges, with the rows purged (``part`` =
    "purged") whose features or labels reach across an edge.

    A row's features look back ``before`` rows and its label looks ``after`` rows ahead, so
    the ``before`` + ``after`` rows in front of an edge share prices with the part behind it. An edge is a place in the series: the share of its rows, rounded
    down. Places come from one window per series over whole numbers only (a series has one
    row per bucket of its time span).
    """
    place = F.row_number().over(Window.partitionBy(*series).orderBy(order)) - 1
    rows = F.count(F.lit(1)).over(Window.partitionBy(*series))
    gap = before + after
    edges = [F.floor(F.col("_rows") * F.lit(share) + F.lit(1e-9)) for share in (train_share, train_validation_share)]
    near = F.lit(False)
    for edge in edges:
        near = near | ((F.col("_place") < edge) & (F.col("_place") >= edge - gap))
    part = F.when(near, "purged").when(F.col("_place") < edges[0], "train").when(F.col("_place") < edges[1], "validation").otherwise("test")
    return df.withColumn("_place", place).withColumn("_rows", rows).withColumn("part", part).drop("_place", "_rows")


def hash_sample(df: DataFrame, fraction: float, key_cols: Sequence[str] = DEFAULT_KEY) -> DataFrame:
    """Reproducible sample without replacement: rows whose 32-bit key hash is below
    ``fraction`` of its range; fraction 0 keeps none, 1 keeps every row."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"fraction must be between 0 and 1, got {fraction}")
    return df.where(key_hash(key_cols) < F.lit(int(round(fraction * 2**32))).cast("bigint"))
