"""IO2-IO5, IO7: feature-table storage and report exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FEATURES

FEATURES_WITH_INTERVAL = T.StructType([T.StructField("interval_min", T.IntegerType()), *FEATURES.fields])


def write_feature_tables(df: DataFrame, path: str, fmt: str = "parquet", seen: Observation | None = None) -> None:
    """IO3: write feature tables of one or more intervals, one folder per interval.

    Only the intervals in ``df`` are replaced; other intervals at ``path`` stay. Rows are
    dealt by hash of (interval, series, month) and sorted within files, so no sampling pass
    runs the windows twice, a long series spans several files, and Parquet min/max
    statistics still prune series and time ranges.

    ``seen`` observes the rows while they are written, with no pass of its own: ``n_rows``,
    ``n_incomplete`` (a null in any column) and the calendar mismatches of K7. It stands behind
    the shuffle, in the tasks that write, so that a repeated map task does not count twice.
    """
    if "interval_min" not in df.columns:
        raise ValueError("expects an interval_min column (see build_features_all)")
    keys = ["interval_min", "zone", "instance"]
    out = df.repartition(*keys, F.trunc("date", "month")).sortWithinPartitions(*keys, "bucket_epoch")
    if seen is not None:
        out = out.observe(
            seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.exists(F.array(*[F.col(c).isNull() for c in out.columns]), lambda x: x)).alias("n_incomplete"),
            F.count_if(F.hour("bucket_ts") != F.col("hour")).alias("n_hour_mismatch"),
            F.count_if(F.weekday("bucket_ts") + 1 != F.col("iso_dow")).alias("n_dow_mismatch"),
            F.count_if(F.to_date("bucket_ts") != F.col("date")).alias("n_date_mismatch"))
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("interval_min")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_feature_table(spark: SparkSession, path: str, interval: int | None = None, fmt: str = "parquet") -> DataFrame:
    """IO2 / IO7: read stored feature tables with the explicit schema; ``interval`` prunes folders."""
    if fmt == "csv":
        df = spark.read.schema(FEATURES_WITH_INTERVAL).option("header", True).csv(path)
    elif fmt == "parquet":
        df = spark.read.schema(FEATURES_WITH_INTERVAL).parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    if interval is not None:
        df = df.where(F.col("interval_min") == interval).drop("interval_min")
    return df


def series_extract(df: DataFrame, zone: str, instance: str) -> DataFrame:
    """IO4 content: one series' price, date, bucket and hour."""
    return df.where((F.col("zone") == F.lit(zone)) & (F.col("instance") == F.lit(instance))).select(
        "spot_price", "date", "bucket_epoch", "hour"
    )


def export_single_csv(df: DataFrame, path: str) -> None:
    """IO4 / IO5 sink: one CSV file with a header. For small report extracts only."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """IO8: expose frames to SQL as temporary views; returns the view names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return list(tables)


def write_leaderboard(board: DataFrame, path: str) -> None:
    """M16 sink: append a leaderboard (a few rows per search) to a Parquet folder."""
    board.coalesce(1).write.mode("append").parquet(path)


LEADERBOARD_FOLDERS = ("run_id", "interval_min", "zone", "instance", "model")


def write_search(board: DataFrame, path: str) -> None:
    """M16 exactly-once sink: a search's rows (a few) in a folder of their own, by run, series
    and model as far as the board names them. Writing a search again replaces its rows, so a
    repeated or retried write gives each row once; other searches stay."""
    folders = [c for c in LEADERBOARD_FOLDERS if c in board.columns]
    board.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def read_leaderboard(spark: SparkSession, path: str, schema: T.StructType, run_id: str | None = None) -> DataFrame:
    """Rows stored by ``write_search`` (``schema`` of the boards), of one run or of all; no rows if nothing was
    written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(path)
    found = found if run_id is None else found.where(F.col("run_id") == run_id)
    return found.select(*schema.fieldNames())
