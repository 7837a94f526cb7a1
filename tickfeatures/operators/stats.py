"""Descriptive statistics of a feature table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SERIES_KEYS


def label_stddev(df: DataFrame, label: str = "y_future_price") -> DataFrame:
    """A3: sample standard deviation of a label, one row."""
    return df.agg(F.stddev_samp(label).alias("label_stddev"))


def density_daily(df: DataFrame) -> DataFrame:
    """A5: number of buckets per (series, day)."""
    return df.groupBy(*SERIES_KEYS, "date").agg(F.count(F.lit(1)).alias("n_obs"))


def density_mean(df: DataFrame) -> DataFrame:
    """Mean number of buckets per day, per series, ascending."""
    return (
        density_daily(df)
        .groupBy(*SERIES_KEYS)
        .agg(F.avg("n_obs").alias("avg_count"))
        .orderBy("avg_count", *SERIES_KEYS)
    )


def distinct_series(df: DataFrame) -> DataFrame:
    """The distinct (zone, instance) pairs."""
    return df.select(*SERIES_KEYS).distinct()


def domain_counts(df: DataFrame) -> DataFrame:
    """Numbers of zones, instance types and series.

    All from the distinct series (one small aggregate with map-side combine, no expansion of
    the rows for each distinct count): a zone or instance is counted at its first series.
    """
    def firsts(column: str, other: str):
        return F.row_number().over(Window.partitionBy(column).orderBy(other)) == 1

    series = distinct_series(df).select(firsts("zone", "instance").alias("z"), firsts("instance", "zone").alias("i"), "zone", "instance")
    return series.agg(
        F.count_if(F.col("z") & F.col("zone").isNotNull()).alias("n_zones"),
        F.count_if(F.col("i") & F.col("instance").isNotNull()).alias("n_instances"),
        F.count_if(F.col("zone").isNotNull() & F.col("instance").isNotNull()).alias("n_series"),
    )


def domain_lists(df: DataFrame) -> DataFrame:
    """K2: the distinct zones, instance types and series as rows (domain, value)."""
    series = distinct_series(df)
    parts = [F.struct(F.lit("zone").alias("domain"), F.col("zone").alias("value")),
             F.struct(F.lit("instance").alias("domain"), F.col("instance").alias("value")),
             F.struct(F.lit("series").alias("domain"), F.concat_ws("/", "zone", "instance").alias("value"))]
    return series.select(F.inline(F.array(*parts))).distinct()


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Row count per value of a flag."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def obs_per_series(df: DataFrame) -> DataFrame:
    """Rows per series, ascending."""
    return df.groupBy(*SERIES_KEYS).agg(F.count(F.lit(1)).alias("n")).orderBy("n", *SERIES_KEYS)


def mean_change_per_series(df: DataFrame) -> DataFrame:
    """Mean price change per series, ascending."""
    return (
        df.groupBy(*SERIES_KEYS)
        .agg(F.avg("price_change").alias("avg_price_change"))
        .orderBy("avg_price_change", *SERIES_KEYS)
    )


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered column pair, long form (feat1, feat2, corr), each
    over the rows where both columns are known (not null, not NaN).

    A masked Gram matrix: a row becomes the vector of (known, value, value squared) of each
    column, value less the column's mean and 0 where it is unknown. The product sums of
    these 3k entries hold, for every pair at once, the count, sums, squares and products over
    the rows that know both. One pass with partial sums in every task gives them, whatever
    patterns of nulls there are; a first pass gives the means, which only keep the sums
    small. Only the (3k)^2 matrix reaches the driver. A constant column correlates as null.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    cols = list(columns)
    k = len(cols)
    rows = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)]).first()
        if not first["n"]:
            return df.sparkSession.createDataFrame([(a, b, None) for a in cols for b in cols], "feat1 string, feat2 string, corr double")
        centred = [F.col(f"c{i}") - F.lit(first[f"m{i}"] or 0.0) for i in range(k)]
        known = [F.col(f"c{i}").isNotNull().cast("double") for i in range(k)]
        vector = array_to_vector(F.array(*known, *[F.coalesce(x, F.lit(0.0)) for x in centred], *[F.coalesce(x * x, F.lit(0.0)) for x in centred]))
        gram = RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(vector.alias("v")), "v"), first["n"], 3 * k).computeGramianMatrix().toArray()
    finally:
        rows.unpersist()
    out = [(a, b, _correlation(gram, k, i, j, [first[f"m{x}"] or 0.0 for x in (i, j)])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(out, "feat1 string, feat2 string, corr double")


def _correlation(gram, k: int, i: int, j: int, means: Sequence[float]) -> float | None:
    """Of columns i and j over the rows that know both."""
    n = gram[i, j]
    if n < 2:
        return None
    sums = gram[k + i, j], gram[k + j, i]
    xx, yy = gram[2 * k + i, j] - sums[0] ** 2 / n, gram[2 * k + j, i] - sums[1] ** 2 / n
    xy = gram[k + i, k + j] - sums[0] * sums[1] / n
    if any(v <= 1e-18 * n * max(1.0, m * m) for v, m in ((xx, means[0]), (yy, means[1]))):
        return None
    return float(xy / math.sqrt(xx * yy))


def correlation_with_labels(df: DataFrame, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Correlation of each feature with each label: (feature, label, corr)."""
    feats, labs = list(features), list(labels)
    m = pearson_matrix(df, list(dict.fromkeys(feats + labs)))
    return m.where(F.col("feat1").isin(feats) & F.col("feat2").isin(labs)).select(
        F.col("feat1").alias("feature"), F.col("feat2").alias("label"), "corr"
    )


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """|correlation| of every ordered feature pair in long form, descending; one pass."""
    return pearson_matrix(df, features).withColumn("corr", F.abs("corr")).orderBy(
        F.desc_nulls_last("corr"), "feat1", "feat2"
    )


def first_of_day(df: DataFrame) -> DataFrame:
    """O3: first bucket of each (series, day) and its price."""
    return df.groupBy(*SERIES_KEYS, "date").agg(
        F.min("bucket_epoch").alias("first_bucket"),
        F.min_by("spot_price", "bucket_epoch").alias("first_price"),
    )


def top_n_series(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` series in (zone, instance) order."""
    return distinct_series(df).orderBy(*SERIES_KEYS).limit(n)


def distinct_value_counts(df: DataFrame, columns: Sequence[str], max_categories: int = 4) -> DataFrame:
    """T4 support: exact distinct count per column, and whether it is categorical (<= max).

    Long form (column, value) -> distinct -> count: only distinct values are
    shuffled, with map-side de-duplication.
    """
    longf = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns
    ])))
    return (
        longf.where(F.col("value").isNotNull())
        .distinct()
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n_distinct"))
        .withColumn("is_categorical", (F.col("n_distinct") <= max_categories).cast("int"))
    )


def bounded_distinct(df: DataFrame, columns: Sequence[str], most: int = 4) -> DataFrame:
    """T4: the values of every column with at most ``most`` distinct ones, long form (feature,
    value); columns with more have no row, nulls are no value.

    Successive minima: each round takes, of all columns still open, the least value above
    the last one, in one aggregate without grouping. ``most`` + 1 rounds tell a column with
    more values, so no value set is ever gathered or shuffled, however many there are.
    """
    found: dict[str, list[float]] = {c: [] for c in columns}
    rows = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        still = list(range(len(found)))
        for _ in range(most + 1):
            if not still:
                break
            names = [columns[i] for i in still]
            above = [F.col(f"c{i}") > F.lit(found[c][-1]) if found[c] else F.lit(True) for i, c in zip(still, names, strict=True)]
            least = rows.agg(*[F.min(F.when(a, F.col(f"c{i}"))).alias(f"c{i}") for i, a in zip(still, above, strict=True)]).first()
            still = [i for i in still if least[f"c{i}"] is not None]
            for i in still:
                found[columns[i]].append(least[f"c{i}"])
    finally:
        rows.unpersist()
    values = [(c, v) for c, seen in found.items() if len(seen) <= most for v in seen]
    return df.sparkSession.createDataFrame(values, "feature string, value double")
