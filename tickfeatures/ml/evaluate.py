"""Evaluation metrics as DataFrame aggregates.

These are the formulas of Spark ML's evaluators, written as (grouped)
aggregates so one pass scores every series or every candidate model at once.
The tests check them against ``pyspark.ml.evaluation``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import current_direction
from ..operators.prefix import prefix_sums
from ..schemas import EPSILON, SERIES_KEYS


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def accuracy(df: DataFrame, prediction: str | Column, label: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with prediction == label, and the test error 1 - accuracy."""
    hit = (_c(prediction) == _c(label)).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit).alias("accuracy"),
        (F.lit(1.0) - F.avg(hit)).alias("test_error"),
    )


def rmse(df: DataFrame, prediction: str | Column, label: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error, the label's sample stddev and their ratio (normalised RMSE)."""
    err = F.pow(_c(prediction) - _c(label), 2)
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(err)).alias("rmse"), F.stddev_samp(_c(label)).alias("label_stddev"))
        .withColumn("nrmse", F.try_divide(F.col("rmse"), F.col("label_stddev")))
    )


def auc(df: DataFrame, score: str | Column, label: str | Column, by: Sequence[str] = (),
        buckets: int | None = None) -> DataFrame:
    """Exact area under the ROC curve (ties count one half), per ``by`` group.

    AUC = sum over distinct scores s of pos(s) * (neg(< s) + neg(s) / 2) / (P * N). The
    running count neg(< s) is a distributed prefix sum over the distinct scores
    (``operators.prefix``), so no task holds all scores of a group. ``buckets``: ranges of
    scores, else the session's partitions.
    """
    by = list(by)
    y = (_c(label) > 0.5).cast("long")
    g = df.where(_c(score).isNotNull() & _c(label).isNotNull()).groupBy(*by, _c(score).alias("_s")).agg(
        F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg")
    )
    g = prefix_sums(g, ["_s"], {"_below": F.col("_neg")}, by, buckets)
    return (
        g.groupBy(*by)
        .agg(
            F.sum("_pos").alias("n_pos"),
            F.sum("_neg").alias("n_neg"),
            F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") * 0.5)).alias("_u"),
        )
        .withColumn("auc", F.try_divide(F.col("_u"), F.col("n_pos") * F.col("n_neg")))
        .drop("_u")
    )


def persistence_accuracy(features: DataFrame, eps: float = EPSILON) -> DataFrame:
    """M9 / M10 baseline: predict the next direction = the current direction, per series."""
    pred = current_direction("price_change", eps).cast("double")
    return accuracy(features, pred, "y_direction", SERIES_KEYS)


def persistence_rmse(features: DataFrame) -> DataFrame:
    """M12 / M13 baseline: predict the next price = the current price, per series."""
    return rmse(features, "spot_price", "y_future_price", SERIES_KEYS)


def momentum_auc(features: DataFrame) -> DataFrame:
    """M11 baseline: the current price change as a score for the next increase, per series."""
    return auc(features, "price_change", "y_increase", SERIES_KEYS)
