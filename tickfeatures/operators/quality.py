"""Data-quality checks, computed over all rows as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import bucket_start, epoch_seconds
from ..schemas import SERIES_KEYS
from .stats import distinct_series, domain_counts, domain_lists

TOLERANCE = 1e-9


def schema_problems(df: DataFrame, expected: T.StructType) -> list[str]:
    """K1: differences between a table's schema and the expected one (empty when equal)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for f in expected.fields:
        if f.name not in have:
            problems.append(f"missing {f.name}")
        elif have[f.name] != f.dataType:
            problems.append(f"{f.name}: {have[f.name].simpleString()} != {f.dataType.simpleString()}")
    return problems


def schema_report(df: DataFrame, expected: T.StructType) -> DataFrame:
    """K1 as rows: ``column, expected, found`` (type names; null: not there) and ``ok``, for the
    expected columns and those beyond them."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in expected.fields}
    rows = [(c, want.get(c), have.get(c), int(want.get(c) == have.get(c))) for c in (*want, *(c for c in have if c not in want))]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, found string, ok int")


def stored_schema_problems(spark: SparkSession, path: str, expected: T.StructType, fmt: str = "parquet") -> list[str]:
    """K1 on a stored feature table: Parquet by name and type, CSV by the header's names."""
    if fmt == "csv":
        have = set(spark.read.option("header", True).csv(path).columns)
        return [f"missing {f.name}" for f in expected.fields if f.name not in have]
    return schema_problems(spark.read.parquet(path), expected)


def completeness(df: DataFrame) -> DataFrame:
    """K3: per zone, how many of all seen instance types it has. ``n_missing`` > 0 marks a
    zone lacking some series. The rows are read once, for the distinct series."""
    series = distinct_series(df)
    instances = series.select("instance").where("instance is not null").distinct().agg(F.count(F.lit(1)).alias("n_all"))
    zones = series.groupBy("zone").agg(F.count("instance").alias("n_instances"))
    return zones.crossJoin(F.broadcast(instances)).select(  # one row
        "zone", "n_instances", (F.col("n_all") - F.col("n_instances")).alias("n_missing"))


def missing_series(df: DataFrame) -> DataFrame:
    """K3: the (zone, instance) pairs that no row has although the zone and the instance
    type occur. The grid is built from the distinct zones and instance types (their
    numbers are domain sizes, not row counts)."""
    series = distinct_series(df).where("zone is not null and instance is not null")
    grid = series.select("zone").distinct().crossJoin(series.select("instance").distinct())
    return grid.join(series, list(SERIES_KEYS), "left_anti")


def prev_day_reconciliation(df: DataFrame) -> DataFrame:
    """The day average recomputed from day D's rows vs the stored previous-day
    average on day D+1, per series: days compared and days that disagree."""
    recomputed = df.groupBy(*SERIES_KEYS, "date").agg(F.avg("spot_price").alias("day_avg"))
    stored = df.groupBy(*SERIES_KEYS, "date").agg(
        F.min("prev_day_avg_price").alias("stored_min"), F.max("prev_day_avg_price").alias("stored_max")
    ).withColumn("date", F.date_sub("date", 1))
    joined = recomputed.join(stored, [*SERIES_KEYS, "date"], "inner")
    bad = (F.abs(F.col("day_avg") - F.col("stored_min")) > TOLERANCE) | (
        F.abs(F.col("day_avg") - F.col("stored_max")) > TOLERANCE
    )
    return joined.groupBy(*SERIES_KEYS).agg(
        F.count(F.lit(1)).alias("days_checked"),
        F.sum(bad.cast("long")).alias("days_mismatched"),
    )


def lag_lead_consistency(df: DataFrame, interval_min: int) -> DataFrame:
    """Over all rows, the row exactly one interval earlier / later must agree
    with the stored change and future price.

    The neighbours come from range frames of exactly one step (at most one row,
    as buckets are unique per series): the same rows a self-join on
    ``bucket_epoch +/- step`` finds, without shuffling the table twice more.
    """
    step = interval_min * 60
    w = Window.partitionBy(*SERIES_KEYS).orderBy("bucket_epoch")
    j = df.select(
        *SERIES_KEYS, "spot_price", "price_change", "y_future_price",
        F.first("spot_price").over(w.rangeBetween(-step, -step)).alias("prev_price"),
        F.first("spot_price").over(w.rangeBetween(step, step)).alias("next_price"),
    )
    change_bad = F.abs(F.col("price_change") - (F.col("spot_price") - F.col("prev_price"))) > TOLERANCE
    future_bad = F.abs(F.col("y_future_price") - F.col("next_price")) > TOLERANCE
    return j.groupBy(*SERIES_KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("prev_price").alias("n_with_prev"),
        F.sum(change_bad.cast("long")).alias("n_change_mismatch"),
        F.count("next_price").alias("n_with_next"),
        F.sum(future_bad.cast("long")).alias("n_future_mismatch"),
    ).fillna(0, subset=["n_change_mismatch", "n_future_mismatch"])


def calendar_consistency(df: DataFrame) -> DataFrame:
    """K7: hour and ISO weekday recomputed from ``bucket_ts`` vs the stored columns."""
    hour_bad = (F.hour("bucket_ts") != F.col("hour")).cast("long")
    dow_bad = ((F.weekday("bucket_ts") + 1) != F.col("iso_dow")).cast("long")
    date_bad = (F.to_date("bucket_ts") != F.col("date")).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(hour_bad).alias("n_hour_mismatch"),
        F.sum(dow_bad).alias("n_dow_mismatch"),
        F.sum(date_bad).alias("n_date_mismatch"),
    )


def series_facts(df: DataFrame, interval_min: int) -> DataFrame:
    """K2-K7 in one pass: a row per series with the counts of the checks above, one scan and one
    shuffle of the table.

    The neighbours of K5 / K6 and the next day's stored average of K4 are windows over the
    same partitioning by series, and the sums by day and by series need no further exchange.
    ``n_day_unknown`` counts the compared days whose averages cannot be told apart from the stored
    ones (nulls). Null zones, instances, dates and buckets are counted like other rows, but
    their days are not compared (K4 is an equi-join). An empty table gives no rows.
    """
    step = interval_min * 60
    near = Window.partitionBy(*SERIES_KEYS).orderBy("bucket_epoch")
    rows = df.select(
        *SERIES_KEYS, "date", "spot_price", "price_change", "y_future_price", "prev_day_avg_price",
        F.first("spot_price").over(near.rangeBetween(-step, -step)).alias("prev_price"),
        F.first("spot_price").over(near.rangeBetween(step, step)).alias("next_price"),
        (F.hour("bucket_ts") != F.col("hour")).alias("hour_bad"),
        ((F.weekday("bucket_ts") + 1) != F.col("iso_dow")).alias("dow_bad"),
        (F.to_date("bucket_ts") != F.col("date")).alias("date_bad"),
    )
    counts = {
        "n_rows": F.count(F.lit(1)),
        "n_with_prev": F.count("prev_price"),
        "n_change_mismatch": F.count_if(F.abs(F.col("price_change") - (F.col("spot_price") - F.col("prev_price"))) > TOLERANCE),
        "n_with_next": F.count("next_price"),
        "n_future_mismatch": F.count_if(F.abs(F.col("y_future_price") - F.col("next_price")) > TOLERANCE),
        "n_hour_mismatch": F.count_if("hour_bad"),
        "n_dow_mismatch": F.count_if("dow_bad"),
        "n_date_mismatch": F.count_if("date_bad"),
    }
    days = rows.groupBy(*SERIES_KEYS, "date").agg(
        *[c.alias(name) for name, c in counts.items()], F.avg("spot_price").alias("day_avg"),
        F.min("prev_day_avg_price").alias("stored_min"), F.max("prev_day_avg_price").alias("stored_max"))
    next_day = Window.partitionBy(*SERIES_KEYS).orderBy(F.unix_date("date")).rangeBetween(1, 1)
    known = F.col("zone").isNotNull() & F.col("instance").isNotNull() & F.col("date").isNotNull()
    days = days.withColumns({
        "checked": known & (F.count(F.lit(1)).over(next_day) > 0),
        "next_min": F.first("stored_min").over(next_day), "next_max": F.first("stored_max").over(next_day)})
    bad = (F.abs(F.col("day_avg") - F.col("next_min")) > TOLERANCE) | (F.abs(F.col("day_avg") - F.col("next_max")) > TOLERANCE)
    return days.groupBy(*SERIES_KEYS).agg(
        *[F.sum(name).alias(name) for name in counts],
        F.count_if("checked").alias("days_checked"),
        F.count_if(F.col("checked") & bad).alias("days_mismatched"),
        F.count_if(F.col("checked") & bad.isNull()).alias("n_day_unknown"))


LAG_LEAD = ("n_rows", "n_with_prev", "n_change_mismatch", "n_with_next", "n_future_mismatch")
CALENDAR = ("n_rows", "n_hour_mismatch", "n_dow_mismatch", "n_date_mismatch")


def reports_of(facts: DataFrame) -> dict[str, DataFrame]:
    """The reports of K2-K7 from ``series_facts`` (one row per series), equal to the single
    checks' on the table. Read the facts from a stored table to scan the rows once."""
    compared = facts.where("days_checked > 0")
    mismatched = F.when(F.col("n_day_unknown") < F.col("days_checked"), F.col("days_mismatched"))
    return {
        "domain_counts": domain_counts(facts),
        "domain_lists": domain_lists(facts),
        "completeness": completeness(facts),
        "missing_series": missing_series(facts),
        "prev_day": compared.select(*SERIES_KEYS, "days_checked", mismatched.alias("days_mismatched")),
        "lag_lead": facts.select(*SERIES_KEYS, *LAG_LEAD),
        "calendar": facts.agg(*[(F.coalesce(F.sum(c), F.lit(0)) if c == "n_rows" else F.sum(c)).alias(c) for c in CALENDAR]),
    }


ROW_STAGES = ("ticks", "resampled", "after_lag_drop", "after_lead_drop", "after_prev_day_join")


def row_loss(ticks: DataFrame, interval_min: int) -> DataFrame:
    """Rows after each stage of the build, in one pass over the ticks.

    The stages only mark rows instead of dropping them: a bucket has its lags if it and the
    three before it have prices, its lead if a later marked bucket follows, its previous
    day if that day has a marked bucket. All windows share one shuffle of the buckets;
    the flags and the tick counts are summed once.
    """
    e = epoch_seconds("ts")
    buckets = ticks.groupBy(*SERIES_KEYS, bucket_start(e, interval_min).alias("bucket_epoch")).agg(
        F.avg("spot_price").alias("price"), F.count(F.lit(1)).alias("n_ticks"))
    whole = F.col("bucket_epoch").isNotNull()
    # ticks without a time share a null bucket: windows of their own (whole is a partition key)
    order = Window.partitionBy(*SERIES_KEYS, "whole").orderBy("bucket_epoch")
    rows = buckets.withColumn("whole", whole)
    lagged = F.count("price").over(order.rowsBetween(-3, 0)) == 4
    rows = rows.withColumn("lagged", F.col("whole") & lagged)
    later = F.count_if("lagged").over(order.rowsBetween(1, Window.unboundedFollowing)) > 0
    rows = rows.withColumn("led", F.col("lagged") & later).withColumn("day", F.floor(F.col("bucket_epoch") / 86400))
    by_day = Window.partitionBy(*SERIES_KEYS, "whole").orderBy("day").rangeBetween(-1, -1)
    rows = rows.withColumn("joined", F.col("led") & (F.count_if("led").over(by_day) > 0))
    sums = rows.agg(F.coalesce(F.sum("n_ticks"), F.lit(0)).alias("s0"), *[F.count_if(c).alias(f"s{i}") for i, c in enumerate(("whole", "lagged", "led", "joined"), 1)])
    stages = [F.struct(F.lit(i).alias("stage_order"), F.lit(n).alias("stage"), F.col(f"s{i}").alias("rows")) for i, n in enumerate(ROW_STAGES)]
    return sums.select(F.inline(F.array(*stages)))
