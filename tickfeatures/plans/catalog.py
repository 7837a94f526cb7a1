"""The query catalogue: every operator of the survey as a (spark, sf_dir) -> DataFrame
function, and, where SQL can express it, the same query as DuckDB SQL text.

Inputs are the test tables (``events`` mapped onto price ticks). Every Spark
result passes through ``stable_round`` and every SQL result rounds its doubles
the same way, so the two can be compared by value hash.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.check import stable_round
from ..functions.pricing import caps_frame, region_of, uncovered_series, with_price_cap
from ..functions.time import bucket_start, date_of, epoch_seconds, hour_of, slot_in_hour
from ..ml.evaluate import momentum_auc, persistence_accuracy, persistence_rmse, rmse
from ..operators import quality, stats
from ..operators.daily import (
    daily_stats,
    fill_with_mean,
    join_previous_day,
    previous_day_by_range,
    shift_days,
)
from ..operators.prefix import numbered
from ..operators.resample import resample
from ..operators.split import hash_sample, with_split, with_two_way_split
from ..schemas import (
    CAPS,
    EPSILON,
    FEATURE_COLUMNS,
    INTERVALS,
    LABELS,
    PRICE_CAPS,
    SELECTED_FEATURES,
    FEATURES,
    SERIES_KEYS,
    numeric_features,
)
from ..session import ensure_checkpoint_dir
from ..sources.tables import read_feature_table, series_extract, write_feature_tables
from ..sources.ticks import load_event_ticks
from . import oracle as O
from .features import (
    SERIES_WINDOW_KEYS,
    add_lags,
    bucket_table,
    build_features,
    build_features_all,
    changes_and_flags,
    with_leads,
    with_previous_day,
)

QueryFn = Callable[[SparkSession, str], DataFrame]

# Fixed probes of the manual check, moved onto the test data: the series
# us-west-2a / m1.medium and a day of the month (the 12th).
PROBE_ZONE, PROBE_INSTANCE = "us-west-2a", "m1.medium"
PROBE_DAY = _dt.date(2024, 1, 12)
TOP_SERIES = 4
SAMPLE_FRACTION = 0.3

K = ("zone", "instance", "bucket_epoch")


# --------------------------------------------------------------------------- stages
def _ticks(spark, sf):
    return load_event_ticks(spark, sf)


def _bk(spark, sf, iv=60):
    return bucket_table(_ticks(spark, sf), [iv])


def _lg(spark, sf, iv=60):
    return add_lags(_bk(spark, sf, iv))


def _ch(spark, sf, iv=60):
    return changes_and_flags(_lg(spark, sf, iv), EPSILON)


def _ld(spark, sf, iv=60):
    return with_leads(_ch(spark, sf, iv))


def _ft(spark, sf, iv=60):
    return build_features(_ticks(spark, sf), iv)


def _pd(spark, sf, iv=60):
    return join_previous_day(_ld(spark, sf, iv), SERIES_WINDOW_KEYS)


QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return stable_round(fn(spark, sf_dir))

        wrapped.__name__ = name
        wrapped.__doc__ = fn.__doc__
        QUERIES[name] = wrapped
        if sql is not None:
            ORACLE[name] = sql
        return wrapped

    return deco


def _w(upto: str, iv: int = 60) -> str:
    return O.ctes([iv], EPSILON, upto)


# --------------------------------------------------------------------------- sources
@query("ticks", f"{_w('ticks')}\nSELECT zone, instance, ts, {O.r('spot_price')} FROM ticks")
def q_ticks(spark, sf):
    """IO1: normalised ticks."""
    return _ticks(spark, sf)


@query("time_parts", f"""{_w('ticks')}
SELECT zone, instance, e AS epoch, DATE '1970-01-01' + CAST(floor(e / 86400) AS INTEGER) AS date,
  CAST(floor((((e % 86400) + 86400) % 86400) / 3600) AS INTEGER) AS hour,
  CAST(floor((((e % 3600) + 3600) % 3600) / 60) AS INTEGER) AS minute,
  e - (((e % 900) + 900) % 900) AS bucket_15,
  CAST(floor((((e % 3600) + 3600) % 3600) / 900) + 1 AS INTEGER) AS slot_15
FROM (SELECT zone, instance, CAST(floor(epoch(ts)) AS BIGINT) AS e FROM ticks)""")
def q_time_parts(spark, sf):
    """epoch, date, hour, minute, 15-minute bucket and slot of every tick."""
    t = _ticks(spark, sf).select("zone", "instance", epoch_seconds("ts").alias("epoch"))
    b = bucket_start("epoch", 15)
    return t.select(
        "zone", "instance", "epoch", date_of("epoch").alias("date"), hour_of("epoch").alias("hour"),
        F.floor(F.pmod("epoch", F.lit(3600)) / 60).cast("int").alias("minute"),
        b.alias("bucket_15"), slot_in_hour(b, 15).alias("slot_15"),
    )


_FAULTY = """CASE event_id % 50 WHEN 0 THEN 'malformed' WHEN 1 THEN 'series' WHEN 2 THEN 'time' WHEN 3 THEN 'price' ELSE 'ok' END"""


@query("ticks_rejects", f"""SELECT {_FAULTY} AS reason, count(*) AS n,
  CAST(sum(CASE WHEN event_id % 50 IN (0, 2) THEN NULL ELSE floor(epoch(ts)) END) AS BIGINT) AS epoch_sum,
  CAST(sum(CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS broken_lines FROM events GROUP BY 1""")
def q_ticks_rejects(spark, sf):
    """IO1 / F5: all events as source lines, of which some are cut off, lack a zone, or have no
    readable time or price, and some give their time with an offset; rows by reason."""
    from ..sources.ticks import checked_ticks
    events = spark.read.schema("event_id bigint, ts timestamp_ntz, value double").parquet(f"{sf}/events.parquet")
    fault = F.pmod("event_id", F.lit(50))
    stamp = lambda t, end: F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(end))
    time = (
        F.when(fault == 2, "yesterday")
        .when(fault == 4, stamp(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "+02:00"))
        .when(fault == 5, stamp(F.col("ts") - F.expr("INTERVAL '05:30' HOUR TO MINUTE"), "-0530"))
        .when(fault == 6, stamp(F.col("ts"), ""))
        .otherwise(stamp(F.col("ts"), ".000Z"))
    )
    line = F.to_json(F.struct(
        time.alias("TimeStamp"),
        F.when(fault == 3, "n/a").otherwise(F.col("value").cast("string")).alias("SpotPrice"),
        F.when(fault != 1, "eu-west-1a").alias("AvailabilityZone"),
        F.lit("m1.medium").alias("InstanceType"),
    ))
    lines = events.select(F.when(fault == 0, F.substring(line, 1, 30)).otherwise(line).alias("value"))
    checked = checked_ticks(lines)
    return checked.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(epoch_seconds("ts")).alias("epoch_sum"), F.sum((~F.col("line").endswith("}")).cast("bigint")).alias("broken_lines"))


@query("ticks_json_roundtrip", f"{_w('res')}\nSELECT zone, instance, bucket_epoch, {O.r('spot_price')} FROM res")
def q_ticks_json_roundtrip(spark, sf):
    """IO1: all ticks written as JSON lines in the source format, read back with the JSON
    reader (explicit schema, text parsing), then resampled hourly."""
    from ..sources.ticks import read_ticks_json, write_ticks_json
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ticks_json_{uuid.uuid4().hex}"
    write_ticks_json(_ticks(spark, sf), path)
    return resample(read_ticks_json(spark, path), 60)


def _register_resample(iv: int) -> None:
    @query(f"resample_{iv}", f"{_w('res', iv)}\nSELECT zone, instance, bucket_epoch, {O.r('spot_price')} FROM res")
    def q(spark, sf):
        """A1: mean price per series and bucket."""
        return resample(_ticks(spark, sf), iv)


for _iv in INTERVALS:
    _register_resample(_iv)


@query("resample_sorted", f"""{_w('res')}
SELECT zone, instance, bucket_epoch, {O.r('spot_price')},
  row_number() OVER (PARTITION BY zone, instance ORDER BY bucket_epoch) AS place FROM res""")
def q_resample_sorted(spark, sf):
    """O1: hourly resample clustered by series and sorted by bucket inside each partition (no
    global sort), with each row's place in its series."""
    place = F.row_number().over(Window.partitionBy("zone", "instance").orderBy("bucket_epoch"))
    return resample(_ticks(spark, sf), 60).select("*", place.cast("bigint").alias("place")).sortWithinPartitions(*K)


_CAL = ["zone", "instance", "bucket_epoch", "date", "hour", "slot", "iso_dow", "is_weekday",
        "is_work_6_18", "is_work_9_17", "is_work_8_18", "is_night"]


@query("calendar_flags", f"{_w('bk')}\nSELECT {', '.join(_CAL)} FROM bk")
def q_calendar_flags(spark, sf):
    """F8, P10: calendar columns and flags of hourly buckets."""
    return _bk(spark, sf).select(*_CAL)


@query("irrational_join", f"{_w('bk')}\nSELECT zone, instance, bucket_epoch, {O.r('spot_price')}, "
                          f"{O.r('cap')}, is_irrational FROM bk")
def q_irrational_join(spark, sf):
    """Broadcast join of the cap table on (region, instance) and the at-or-above-cap flag."""
    res = resample(_ticks(spark, sf), 60)
    j = with_price_cap(res, caps_frame(spark))
    return j.select(*K, "spot_price", "cap", (F.col("spot_price") >= F.col("cap")).cast("int").alias("is_irrational"))


@query("zone_region", f"{_w('ticks')}\nSELECT DISTINCT zone, substr(zone, 1, length(zone) - 1) AS region FROM ticks")
def q_zone_region(spark, sf):
    """region of each zone (drop the last letter)."""
    return _ticks(spark, sf).select("zone", region_of("zone").alias("region")).distinct()


# The cap table without its last region's last instance type: some series then lack a cap.
_PARTIAL_CAPS = PRICE_CAPS[:-1]


@query("cap_coverage_anti", f"""{_w('ticks')}
SELECT DISTINCT zone, instance FROM ticks t
WHERE NOT EXISTS (SELECT 1 FROM (VALUES {O._caps_values(_PARTIAL_CAPS)}) caps(region, instance, cap)
                  WHERE caps.region = substr(t.zone, 1, length(t.zone) - 1) AND caps.instance = t.instance)""")
def q_cap_coverage_anti(spark, sf):
    """Series without a cap (left anti join), with one cap withheld; the reference aborts on them."""
    return uncovered_series(_ticks(spark, sf), spark.createDataFrame(list(_PARTIAL_CAPS), CAPS))


# --------------------------------------------------------------------------- windows
@query("price_lags", f"{_w('lg')}\nSELECT zone, instance, bucket_epoch, "
                     f"{O.select_list(['spot_price', 'lag_1', 'lag_2', 'lag_3'], ['spot_price', 'lag_1', 'lag_2', 'lag_3'])} FROM lg")
def q_price_lags(spark, sf):
    """Previous three observed hourly prices per series (before any drop)."""
    return _lg(spark, sf).select(*K, "spot_price", "lag_1", "lag_2", "lag_3")


@query("price_lags_sql", f"{_w('lg')}\nSELECT zone, instance, bucket_epoch, "
                         f"{O.select_list(['spot_price', 'lag_1', 'lag_2', 'lag_3'], ['spot_price', 'lag_1', 'lag_2', 'lag_3'])} FROM lg")
def q_price_lags_sql(spark, sf):
    """IO8 / IO9: the lag query as SQL text over a temporary view (same plan as ``price_lags``)."""
    from ..sources.tables import register_views
    view = f"hourly_buckets_{uuid.uuid4().hex[:8]}"
    register_views(spark, {view: _bk(spark, sf)})
    w = "OVER (PARTITION BY interval_min, zone, instance ORDER BY bucket_epoch)"
    try:
        return spark.sql(
            f"SELECT zone, instance, bucket_epoch, spot_price, lag(spot_price, 1) {w} AS lag_1, "
            f"lag(spot_price, 2) {w} AS lag_2, lag(spot_price, 3) {w} AS lag_3 FROM {view}"
        )
    finally:
        spark.catalog.dropTempView(view)  # the plan is analysed already


_PC = ["price_change", "price_change_lag1", "price_change_lag2"]


@query("price_changes", f"{_w('ch')}\nSELECT zone, instance, bucket_epoch, {O.select_list(_PC, _PC)} FROM ch")
def q_price_changes(spark, sf):
    """price change and its two lags."""
    return _ch(spark, sf).select(*K, *_PC)


@query("direction_flags", f"""{_w('ch')}
SELECT zone, instance, bucket_epoch, {O.r('price_change')}, CAST(inc_t AS INTEGER) AS is_up,
  CAST(dec_t AS INTEGER) AS is_down, CAST(same_t AS INTEGER) AS is_same FROM ch""")
def q_direction_flags(spark, sf):
    """Up / down / same flags of the change with threshold 0.001."""
    return _ch(spark, sf).select(
        *K, "price_change", F.col("inc_t").cast("int").alias("is_up"),
        F.col("dec_t").cast("int").alias("is_down"), F.col("same_t").cast("int").alias("is_same"),
    )


_LD = ["y_increase", "y_decrease", "y_same", "y_future_price", "y_direction"]


@query("lead_labels", f"{_w('ld')}\nSELECT zone, instance, bucket_epoch, {O.select_list(_LD, _LD)} FROM ld")
def q_lead_labels(spark, sf):
    """Next-step labels (after both drops)."""
    return _ld(spark, sf).select(*K, *_LD)


@query("multi_label", f"{_w('ld')}\nSELECT {O.r('y_direction')}, count(*) AS n FROM ld GROUP BY y_direction")
def q_multi_label(spark, sf):
    """Class sizes of the multi-class direction label."""
    return _ld(spark, sf).groupBy("y_direction").agg(F.count(F.lit(1)).alias("n"))


@query("drop_incomplete", f"{_w('ld')}\nSELECT zone, instance, bucket_epoch, "
                          f"{O.select_list(['spot_price', 'lag_3', 'y_future_price'], ['spot_price', 'lag_3', 'y_future_price'])} FROM ld")
def q_drop_incomplete(spark, sf):
    """Rows left after dropping rows without three lags or without a next step."""
    return _ld(spark, sf).select(*K, "spot_price", "lag_3", "y_future_price")


# --------------------------------------------------------------------------- daily statistics
_PDC = ["prev_day_avg_price", "prev_day_max_price", "prev_day_min_price", "prev_day_avg_change",
        "prev_day_max_change", "prev_day_min_change", "prev_day_std_change"]


@query("daily_stats", f"{_w('dl')}\nSELECT zone, instance, date, {O.select_list(_PDC, _PDC)} FROM dl")
def q_daily_stats(spark, sf):
    """A2: per series and day: avg/max/min price, avg/max/min/stddev change."""
    return daily_stats(_ld(spark, sf)).select("zone", "instance", "date", *_PDC)


@query("daily_stats_shifted", f"{_w('dl')}\nSELECT zone, instance, date + 1 AS date, {O.select_list(_PDC, _PDC)} FROM dl")
def q_daily_stats_shifted(spark, sf):
    """the daily statistics moved to the next day."""
    return shift_days(daily_stats(_ld(spark, sf))).select("zone", "instance", "date", *_PDC)


_PJ_SQL = f"{_w('pd')}\nSELECT zone, instance, bucket_epoch, date, {O.select_list(_PDC, _PDC)} FROM pd"


@query("prev_day_join", _PJ_SQL)
def q_prev_day_join(spark, sf):
    """Inner join of rows with the previous day's statistics (std not yet filled)."""
    return _pd(spark, sf).select(*K, "date", *_PDC)


@query("prev_day_range_window", _PJ_SQL)
def q_prev_day_range_window(spark, sf):
    """J1, window form: RANGE 1 PRECEDING AND 1 PRECEDING over the day number."""
    return previous_day_by_range(_ld(spark, sf), SERIES_WINDOW_KEYS).select(*K, "date", *_PDC)


# Days with at most this many rows lose their standard deviation, as one-row days do.
_SPARSE_DAY = 12


@query("stddev_fill", f"""{_w('pd')},
dn AS (SELECT zone, instance, date, count(*) AS k FROM ld GROUP BY zone, instance, date),
sp AS (SELECT pd.zone, pd.instance, pd.bucket_epoch, CASE WHEN dn.k > {_SPARSE_DAY} THEN pd.prev_day_std_change END AS s
       FROM pd JOIN dn ON dn.zone = pd.zone AND dn.instance = pd.instance AND dn.date = pd.date)
SELECT zone, instance, bucket_epoch, {O.r('coalesce(s, avg(s) OVER ())', 'prev_day_std_change')},
  CAST(s IS NULL AS INTEGER) AS was_filled FROM sp""")
def q_stddev_fill(spark, sf):
    """Null previous-day stddev replaced by the mean stddev (rows of sparse days have none)."""
    day = Window.partitionBy(*SERIES_WINDOW_KEYS, "date")
    pd = join_previous_day(_ld(spark, sf).withColumn("k", F.count(F.lit(1)).over(day)), SERIES_WINDOW_KEYS)
    pd = pd.withColumn("prev_day_std_change", F.when(F.col("k") > _SPARSE_DAY, F.col("prev_day_std_change")))
    pd = pd.withColumn("was_filled", F.col("prev_day_std_change").isNull().cast("int"))
    return fill_with_mean(pd, "prev_day_std_change", by=("interval_min",)).select(*K, "prev_day_std_change", "was_filled")


_PDS = [*_PDC, "diff_mean_price", "abs_diff_mean_change"]


@query("prev_day_stats", f"{_w('ft')}\nSELECT zone, instance, bucket_epoch, date, {O.select_list(_PDS, _PDS)}, is_volatile FROM ft")
def q_prev_day_stats(spark, sf):
    """Previous-day statistics, mean differences, filled stddev and volatility."""
    return with_previous_day(_ld(spark, sf)).select(*K, "date", *_PDS, "is_volatile")


@query("diff_mean", f"{_w('ft')}\nSELECT zone, instance, bucket_epoch, "
                    f"{O.select_list(['diff_mean_price', 'abs_diff_mean_change'], ['diff_mean_price', 'abs_diff_mean_change'])} FROM ft")
def q_diff_mean(spark, sf):
    """price minus previous-day mean price; |change minus previous-day mean change|."""
    return _ft(spark, sf).select(*K, "diff_mean_price", "abs_diff_mean_change")


@query("volatility_flag", f"{_w('ft')}\nSELECT zone, instance, bucket_epoch, "
                          f"{O.select_list(['price_change', 'prev_day_std_change'], ['price_change', 'prev_day_std_change'])}, is_volatile FROM ft")
def q_volatility_flag(spark, sf):
    """Change above two previous-day standard deviations (one-sided)."""
    return _ft(spark, sf).select(*K, "price_change", "prev_day_std_change", "is_volatile")


@query("fill_constant", f"""{_w('lg')}
SELECT zone, instance, bucket_epoch, {O.r('coalesce(spot_price - lag_1, 0.0)', 'price_change')},
  {O.r('coalesce(lead(spot_price) OVER (PARTITION BY zone, instance ORDER BY bucket_epoch), 0.0)', 'y_future_price')} FROM lg""")
def q_fill_constant(spark, sf):
    """Nulls of price change and future price (each series' ends, before the drops) set to 0.0."""
    nxt = F.lead("spot_price").over(Window.partitionBy(*SERIES_WINDOW_KEYS).orderBy("bucket_epoch"))
    rows = _lg(spark, sf).select(*K, (F.col("spot_price") - F.col("lag_1")).alias("price_change"), nxt.alias("y_future_price"))
    return rows.fillna(0.0, subset=["price_change", "y_future_price"])


# --------------------------------------------------------------------------- feature tables
def _register_feature_table(iv: int) -> None:
    @query(f"feature_table_{iv}", O.feature_table_sql(iv))
    def q(spark, sf):
        """The 36-column feature table."""
        return _ft(spark, sf, iv)


for _iv in INTERVALS:
    _register_feature_table(_iv)


@query("feature_table_all", O.feature_table_all_sql(INTERVALS))
def q_feature_table_all(spark, sf):
    """IO6: the three feature tables from one scan of the ticks, keyed by interval_min."""
    return build_features_all(_ticks(spark, sf), INTERVALS)


@query("feature_csv_roundtrip", O.feature_table_sql(60))
def q_feature_csv_roundtrip(spark, sf):
    """IO2, IO3, IO7: write all intervals as CSV (one folder per interval), read back hourly.

    The folder lives under the session's checkpoint directory (shared storage on a cluster).
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/feature_csv_{uuid.uuid4().hex}"
    write_feature_tables(build_features_all(_ticks(spark, sf), INTERVALS), path, fmt="csv")
    return read_feature_table(spark, path, 60, fmt="csv").select(*FEATURE_COLUMNS)


# --------------------------------------------------------------------------- filters, joins, samples
def _ft_where(cond: str) -> str:
    return f"{O.ctes([60])}\nSELECT {O.feature_select()} FROM ft WHERE {cond}"


@query("series_subset", _ft_where(f"zone = '{PROBE_ZONE}' AND instance = '{PROBE_INSTANCE}'"))
def q_series_subset(spark, sf):
    """One series, selected with column values."""
    ft = _ft(spark, sf)
    return ft.where((F.col("zone") == F.lit(PROBE_ZONE)) & (F.col("instance") == F.lit(PROBE_INSTANCE)))


@query("day_slice", _ft_where(f"date = DATE '{PROBE_DAY.isoformat()}'"))
def q_day_slice(spark, sf):
    """All series on one day."""
    return _ft(spark, sf).where(F.col("date") == F.lit(PROBE_DAY))


@query("series_export", f"{_w('ft')}\nSELECT {O.r('spot_price')}, date, bucket_epoch, hour FROM ft "
                        f"WHERE zone = '{PROBE_ZONE}' AND instance = '{PROBE_INSTANCE}'")
def q_series_export(spark, sf):
    """IO4: the single-series extract (price, date, bucket, hour)."""
    return series_extract(_ft(spark, sf), PROBE_ZONE, PROBE_INSTANCE)


_TOPN = f"(SELECT DISTINCT zone, instance FROM ft ORDER BY zone, instance LIMIT {TOP_SERIES})"


@query("top_n_series", f"{_w('ft')}\nSELECT * FROM {_TOPN}")
def q_top_n_series(spark, sf):
    """The first four series in (zone, instance) order."""
    return stats.top_n_series(_ft(spark, sf), TOP_SERIES)


@query("series_semi", f"{O.ctes([60])}\nSELECT {O.feature_select()} FROM ft "
                      f"WHERE (zone, instance) IN (SELECT zone, instance FROM {_TOPN})")
def q_series_semi(spark, sf):
    """Rows of the chosen series (left semi join with a bounded series list)."""
    ft = _ft(spark, sf)
    chosen = stats.top_n_series(ft, TOP_SERIES)
    return ft.join(F.broadcast(chosen), list(SERIES_KEYS), "left_semi")


@query("hash_sample", f"""{_w('ft')}
SELECT zone, instance, bucket_epoch, {O.r('spot_price')} FROM ft
WHERE ('0x' || substr(md5(concat_ws('|', zone, instance, CAST(bucket_epoch AS VARCHAR))), 1, 8))::BIGINT
      < {int(round(SAMPLE_FRACTION * 2**32))}""")
def q_hash_sample(spark, sf):
    """Reproducible 30 % sample by key hash."""
    return hash_sample(_ft(spark, sf), SAMPLE_FRACTION).select(*K, "spot_price")


_HB = "('0x' || substr(md5(concat_ws('|', zone, instance, CAST(bucket_epoch AS VARCHAR))), 1, 8))::BIGINT % 100"


@query("hash_split", f"""{_w('ft')}
SELECT zone, instance, bucket_epoch,
  CASE WHEN {_HB} < 56 THEN 'train' WHEN {_HB} < 80 THEN 'validation' ELSE 'test' END AS part FROM ft""")
def q_hash_split(spark, sf):
    """Nested 80/20 then 70/30 split by key hash: train / validation / test."""
    return with_split(_ft(spark, sf)).select(*K, "part")


@query("purged_split", f"""{_w('ft')},
p AS (SELECT zone, instance, bucket_epoch, row_number() OVER (PARTITION BY zone, instance ORDER BY bucket_epoch) - 1 AS i,
        count(*) OVER (PARTITION BY zone, instance) AS n FROM ft),
e AS (SELECT *, CAST(floor(n * 0.56 + 1e-9) AS BIGINT) AS a, CAST(floor(n * 0.8 + 1e-9) AS BIGINT) AS b FROM p)
SELECT zone, instance, bucket_epoch, CASE WHEN i BETWEEN a - 4 AND a - 1 OR i BETWEEN b - 4 AND b - 1 THEN 'purged'
  WHEN i < a THEN 'train' WHEN i < b THEN 'validation' ELSE 'test' END AS part FROM e""")
def q_purged_split(spark, sf):
    """Time split per series without the rows whose lags or label cross an edge."""
    from ..operators.split import with_purged_split
    return with_purged_split(_ft(spark, sf).select(*K)).select(*K, "part")


@query("hash_split_7030", f"""{_w('ft')}
SELECT zone, instance, bucket_epoch, CASE WHEN {_HB} < 70 THEN 'train' ELSE 'test' END AS part FROM ft""")
def q_hash_split_7030(spark, sf):
    """Single 70/30 split by key hash."""
    return with_two_way_split(_ft(spark, sf)).select(*K, "part")


# --------------------------------------------------------------------------- statistics
@query("label_stddev", f"{_w('ft')}\nSELECT {O.r('stddev_samp(y_future_price)', 'label_stddev')} FROM ft")
def q_label_stddev(spark, sf):
    """A3: sample stddev of the regression label, computed once."""
    return stats.label_stddev(_ft(spark, sf))


@query("density_daily", f"{_w('ft')}\nSELECT zone, instance, date, count(*) AS n_obs FROM ft GROUP BY zone, instance, date")
def q_density_daily(spark, sf):
    """A5: buckets per series and day."""
    return stats.density_daily(_ft(spark, sf))


@query("density_mean", f"""{_w('ft')}
SELECT zone, instance, {O.r('a', 'avg_count')}, row_number() OVER (ORDER BY a, zone, instance) AS place FROM
 (SELECT zone, instance, avg(n_obs) AS a FROM
  (SELECT zone, instance, date, count(*) AS n_obs FROM ft GROUP BY zone, instance, date) GROUP BY zone, instance)""")
def q_density_mean(spark, sf):
    """A6 / IO5 / O2: mean buckets per day per series, ascending, with each series' place in the order."""
    return numbered(stats.density_mean(_ft(spark, sf)), ["avg_count", "zone", "instance"])


@query("distinct_series", f"{_w('ft')}\nSELECT DISTINCT zone, instance FROM ft")
def q_distinct_series(spark, sf):
    """Distinct series."""
    return stats.distinct_series(_ft(spark, sf))


@query("qc_schema", "SELECT * FROM (VALUES " + ", ".join(f"('{f.name}', '{f.dataType.simpleString()}', '{f.dataType.simpleString()}', 1)" for f in FEATURES.fields) + ') AS t("column", expected, found, ok)')
def q_qc_schema(spark, sf):
    """K1: the stored hourly table's columns against the feature schema."""
    from ..operators.quality import schema_report
    from ..sources.tables import read_feature_table, write_feature_tables
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/schema_{uuid.uuid4().hex}"
    write_feature_tables(_ft(spark, sf).withColumn("interval_min", F.lit(60)), path)
    stored = spark.read.parquet(path).drop("interval_min")
    return schema_report(stored, FEATURES)


@query("qc_domain_counts", f"""{_w('ft')}
SELECT count(DISTINCT zone) AS n_zones, count(DISTINCT instance) AS n_instances,
  count(DISTINCT (zone, instance)) AS n_series FROM ft""")
def q_qc_domain_counts(spark, sf):
    """Numbers of zones, instance types and series."""
    return stats.domain_counts(_ft(spark, sf))


@query("freq_volatile", f"{_w('ft')}\nSELECT is_volatile, count(*) AS n FROM ft GROUP BY is_volatile")
def q_freq_volatile(spark, sf):
    """Rows per volatility flag."""
    return stats.frequency(_ft(spark, sf), "is_volatile")


@query("freq_irrational", f"{_w('ft')}\nSELECT is_irrational, count(*) AS n FROM ft GROUP BY is_irrational")
def q_freq_irrational(spark, sf):
    """A10: rows per at-or-above-cap flag."""
    return stats.frequency(_ft(spark, sf), "is_irrational")


@query("obs_per_series", f"{_w('ft')}\nSELECT zone, instance, count(*) AS n FROM ft GROUP BY zone, instance")
def q_obs_per_series(spark, sf):
    """Rows per series."""
    return stats.obs_per_series(_ft(spark, sf))


@query("mean_change_per_series", f"{_w('ft')}\nSELECT zone, instance, {O.r('avg(price_change)', 'avg_price_change')} "
                                 f"FROM ft GROUP BY zone, instance")
def q_mean_change_per_series(spark, sf):
    """Mean price change per series."""
    return stats.mean_change_per_series(_ft(spark, sf))


def _cor_features() -> list[str]:
    """Numeric features plus the multi-class label (the reference's correlation list)."""
    from ..schemas import FEATURES
    skip = {"y_increase", "y_decrease", "y_same", "y_future_price"}
    return [f.name for f in FEATURES.fields
            if f.dataType.simpleString() in ("int", "bigint", "double") and f.name not in skip]


_CORR_LABELS = ("y_increase", "y_future_price")


def _pearson_sql(a: str, b: str) -> str:
    both = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"covar_samp({a}, {b}) / NULLIF(stddev_samp({a}) {both} * stddev_samp({b}) {both}, 0)"


def _corr_label_sql() -> str:
    feats = _cor_features()
    sel = ", ".join(f"{_pearson_sql(f, y)} AS c_{i}_{j}" for j, y in enumerate(_CORR_LABELS) for i, f in enumerate(feats))
    unpiv = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, '{y}' AS label, {O.sql_round(f'c_{i}_{j}')} AS corr FROM w"
        for j, y in enumerate(_CORR_LABELS) for i, f in enumerate(feats)
    )
    return f"{_w('ft')},\nw AS (SELECT {sel} FROM ft)\n{unpiv}"


def _corr_matrix_sql() -> str:
    feats = _cor_features()
    pairs = [(i, j) for i in range(len(feats)) for j in range(i, len(feats))]
    sel = ", ".join(f"abs({_pearson_sql(feats[i], feats[j])}) AS c_{i}_{j}" for i, j in pairs)
    rows = []
    for i, j in pairs:
        rows.append(f"SELECT '{feats[i]}' AS feat1, '{feats[j]}' AS feat2, {O.sql_round(f'c_{i}_{j}')} AS corr FROM w")
        if i != j:
            rows.append(f"SELECT '{feats[j]}' AS feat1, '{feats[i]}' AS feat2, {O.sql_round(f'c_{i}_{j}')} AS corr FROM w")
    return f"{_w('ft')},\nw AS (SELECT {sel} FROM ft)\n" + " UNION ALL ".join(rows)


@query("corr_label", _corr_label_sql())
def q_corr_label(spark, sf):
    """Pearson correlation of every feature with the increase label and the future price."""
    return stats.correlation_with_labels(_ft(spark, sf), _cor_features(), _CORR_LABELS)


@query("corr_matrix", _corr_matrix_sql())
def q_corr_matrix(spark, sf):
    """|correlation| of every feature pair in long form, descending; one aggregate."""
    return stats.correlation_matrix(_ft(spark, sf), _cor_features())


@query("first_of_day", f"""{_w('ft')}
SELECT zone, instance, date, min(bucket_epoch) AS first_bucket, {O.r('arg_min(spot_price, bucket_epoch)', 'first_price')}
FROM ft GROUP BY zone, instance, date""")
def q_first_of_day(spark, sf):
    """O3: first bucket of each series-day and its price."""
    return stats.first_of_day(_ft(spark, sf))


# --------------------------------------------------------------------------- quality checks
@query("qc_completeness", f"""{_w('ft')}
SELECT zone, count(DISTINCT instance) AS n_instances,
  CAST((SELECT count(DISTINCT instance) FROM ft) - count(DISTINCT instance) AS BIGINT) AS n_missing
FROM ft GROUP BY zone""")
def q_qc_completeness(spark, sf):
    """K3: per zone, instance types present and missing."""
    return quality.completeness(_ft(spark, sf))


@query("qc_prev_day", f"""{_w('ft')},
rc AS (SELECT zone, instance, date, avg(spot_price) AS day_avg FROM ft GROUP BY zone, instance, date),
st AS (SELECT zone, instance, date - 1 AS date, min(prev_day_avg_price) AS smin, max(prev_day_avg_price) AS smax
       FROM ft GROUP BY zone, instance, date)
SELECT rc.zone, rc.instance, count(*) AS days_checked,
  CAST(sum(CAST(abs(day_avg - smin) > 1e-9 OR abs(day_avg - smax) > 1e-9 AS BIGINT)) AS BIGINT) AS days_mismatched
FROM rc JOIN st ON rc.zone = st.zone AND rc.instance = st.instance AND rc.date = st.date
GROUP BY rc.zone, rc.instance""")
def q_qc_prev_day(spark, sf):
    """Recomputed day average vs stored previous-day average, all series and days."""
    return quality.prev_day_reconciliation(_ft(spark, sf))


@query("qc_lag_lead", f"""{_w('ft')},
j AS (SELECT b.zone, b.instance, b.spot_price, b.price_change, b.y_future_price, p.spot_price AS prev_price,
        n.spot_price AS next_price
      FROM ft b
      LEFT JOIN ft p ON p.zone = b.zone AND p.instance = b.instance AND p.bucket_epoch + 3600 = b.bucket_epoch
      LEFT JOIN ft n ON n.zone = b.zone AND n.instance = b.instance AND n.bucket_epoch - 3600 = b.bucket_epoch)
SELECT zone, instance, count(*) AS n_rows, count(prev_price) AS n_with_prev,
  CAST(coalesce(sum(CAST(abs(price_change - (spot_price - prev_price)) > 1e-9 AS BIGINT)), 0) AS BIGINT) AS n_change_mismatch,
  count(next_price) AS n_with_next,
  CAST(coalesce(sum(CAST(abs(y_future_price - next_price) > 1e-9 AS BIGINT)), 0) AS BIGINT) AS n_future_mismatch
FROM j GROUP BY zone, instance""")
def q_qc_lag_lead(spark, sf):
    """Change and future price agree with the rows one hour before / after."""
    return quality.lag_lead_consistency(_ft(spark, sf), 60)


@query("qc_calendar", f"""{_w('ft')}
SELECT count(*) AS n_rows, CAST(sum(CAST(hour(bucket_ts) <> hour AS BIGINT)) AS BIGINT) AS n_hour_mismatch,
  CAST(sum(CAST(isodow(bucket_ts) <> iso_dow AS BIGINT)) AS BIGINT) AS n_dow_mismatch,
  CAST(sum(CAST(CAST(bucket_ts AS DATE) <> date AS BIGINT)) AS BIGINT) AS n_date_mismatch FROM ft""")
def q_qc_calendar(spark, sf):
    """K7: hour, weekday and date agree with the bucket timestamp."""
    return quality.calendar_consistency(_ft(spark, sf))


@query("qc_series_facts", f"""{_w('ft')},
dmg AS (SELECT zone, instance, date, bucket_ts, bucket_epoch, spot_price,
    CASE WHEN hour = 5 THEN price_change + 1 ELSE price_change END AS price_change,
    CASE WHEN iso_dow = 2 THEN NULL WHEN hour = 7 THEN y_future_price + 1 ELSE y_future_price END AS y_future_price,
    CASE WHEN day(date) % 9 = 0 THEN prev_day_avg_price * 2 ELSE prev_day_avg_price END AS prev_day_avg_price,
    CASE WHEN zone = 'us-west-2a' THEN hour + 1 ELSE hour END AS hour, iso_dow
  FROM ft WHERE NOT (instance = 'c3.large' AND day(date) % 5 = 0)),
j AS (SELECT b.*, p.spot_price AS prev_price, n.spot_price AS next_price
  FROM dmg b
  LEFT JOIN dmg p ON p.zone = b.zone AND p.instance = b.instance AND p.bucket_epoch + 3600 = b.bucket_epoch
  LEFT JOIN dmg n ON n.zone = b.zone AND n.instance = b.instance AND n.bucket_epoch - 3600 = b.bucket_epoch),
s AS (SELECT zone, instance, count(*) AS n_rows, count(prev_price) AS n_with_prev,
    count(*) FILTER (WHERE abs(price_change - (spot_price - prev_price)) > 1e-9) AS n_change_mismatch,
    count(next_price) AS n_with_next,
    count(*) FILTER (WHERE abs(y_future_price - next_price) > 1e-9) AS n_future_mismatch,
    count(*) FILTER (WHERE hour(bucket_ts) <> hour) AS n_hour_mismatch,
    count(*) FILTER (WHERE isodow(bucket_ts) <> iso_dow) AS n_dow_mismatch,
    count(*) FILTER (WHERE CAST(bucket_ts AS DATE) <> date) AS n_date_mismatch
  FROM j GROUP BY zone, instance),
dy AS (SELECT zone, instance, date, avg(spot_price) AS day_avg, min(prev_day_avg_price) AS smin, max(prev_day_avg_price) AS smax
  FROM dmg GROUP BY zone, instance, date),
pd2 AS (SELECT a.zone, a.instance, count(*) AS days_checked,
    count(*) FILTER (WHERE abs(a.day_avg - b.smin) > 1e-9 OR abs(a.day_avg - b.smax) > 1e-9) AS days_mismatched,
    count(*) FILTER (WHERE (abs(a.day_avg - b.smin) > 1e-9 OR abs(a.day_avg - b.smax) > 1e-9) IS NULL) AS n_day_unknown
  FROM dy a JOIN dy b ON a.zone = b.zone AND a.instance = b.instance AND b.date = a.date + 1 GROUP BY a.zone, a.instance)
SELECT s.*, coalesce(days_checked, 0) AS days_checked, coalesce(days_mismatched, 0) AS days_mismatched,
  coalesce(n_day_unknown, 0) AS n_day_unknown
FROM s LEFT JOIN pd2 ON s.zone = pd2.zone AND s.instance = pd2.instance""")
def q_qc_series_facts(spark, sf):
    """K2-K7: all checks of a table in one pass, a row per series, over a table with faults in it."""
    ft = _ft(spark, sf).where("not (instance = 'c3.large' and day(date) % 5 = 0)").withColumns({
        "price_change": F.expr("if(hour = 5, price_change + 1, price_change)"),
        "y_future_price": F.expr("case when iso_dow = 2 then null when hour = 7 then y_future_price + 1 else y_future_price end"),
        "prev_day_avg_price": F.expr("if(day(date) % 9 = 0, prev_day_avg_price * 2, prev_day_avg_price)"),
        "hour": F.expr("if(zone = 'us-west-2a', hour + 1, hour)")})
    return quality.series_facts(ft, 60)


@query("row_loss", f"""{_w('pd')}
SELECT 0 AS stage_order, 'ticks' AS stage, count(*) AS rows FROM ticks
UNION ALL SELECT 1, 'resampled', count(*) FROM res
UNION ALL SELECT 2, 'after_lag_drop', count(*) FROM ch
UNION ALL SELECT 3, 'after_lead_drop', count(*) FROM ld
UNION ALL SELECT 4, 'after_prev_day_join', count(*) FROM pd""")
def q_row_loss(spark, sf):
    """Rows after each stage of the hourly build, from one pass over the ticks."""
    return quality.row_loss(_ticks(spark, sf), 60)


@query("qc_missing_series", f"""{_w('ft')},
s AS (SELECT DISTINCT zone, instance FROM ft WHERE NOT (zone = 'us-west-2b' AND instance = 'c3.large'))
SELECT z.zone, i.instance FROM (SELECT DISTINCT zone FROM s) z, (SELECT DISTINCT instance FROM s) i
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.zone = z.zone AND s.instance = i.instance)""")
def q_qc_missing_series(spark, sf):
    """K3: missing (zone, instance) pairs, with one series withheld from the table."""
    return quality.missing_series(_ft(spark, sf).where("not (zone = 'us-west-2b' and instance = 'c3.large')"))


@query("qc_domain_lists", f"""{_w('ft')}
SELECT 'zone' AS domain, zone AS value FROM ft UNION SELECT 'instance', instance FROM ft
UNION SELECT 'series', zone || '/' || instance FROM ft""")
def q_qc_domain_lists(spark, sf):
    """K2: the distinct zones, instance types and series."""
    return stats.domain_lists(_ft(spark, sf))


# --------------------------------------------------------------------------- ML preparation and baselines
@query("binarize_label", f"{_w('ft')}\nSELECT zone, instance, bucket_epoch, {O.r('y_direction')}, "
                         f"CAST(CASE WHEN y_direction > 0.5 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS label FROM ft")
def q_binarize_label(spark, sf):
    """The direction label binarised at 0.5 (Spark ML Binarizer)."""
    from pyspark.ml.feature import Binarizer
    ft = _ft(spark, sf)
    return Binarizer(threshold=0.5, inputCol="y_direction", outputCol="label").transform(ft).select(*K, "y_direction", "label")


@query("label_index", f"""{_w('ft')}
SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS DOUBLE) AS label_index, n
FROM (SELECT CAST(y_direction AS VARCHAR) AS label, count(*) AS n FROM ft GROUP BY 1)""")
def q_label_index(spark, sf):
    """Frequency-ordered label index (StringIndexer order: count desc, then label)."""
    from ..ml.prepare import label_index_table
    return label_index_table(_ft(spark, sf), "y_direction")


_NUM_FEATURES = [f for f in FEATURE_COLUMNS if f not in LABELS and f not in ("zone", "instance", "date", "bucket_ts")]


@query("categorical_features", f"""{_w('ft')}
SELECT feature, n_distinct, CAST(n_distinct <= 4 AS INTEGER) AS is_categorical FROM (
 {' UNION ALL '.join(f"SELECT '{c}' AS feature, count(DISTINCT CAST({c} AS DOUBLE)) AS n_distinct FROM ft" for c in _NUM_FEATURES)})""")
def q_categorical_features(spark, sf):
    """T4: features with at most 4 distinct values are treated as categorical."""
    ft = _ft(spark, sf)
    return stats.distinct_value_counts(ft, numeric_features(ft), 4)


@query("categorical_values", f"""{_w('ft')},
v AS ({' UNION ALL '.join(f"SELECT DISTINCT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM ft WHERE {c} IS NOT NULL" for c in _NUM_FEATURES)})
SELECT feature, {O.r('value')} FROM v WHERE feature IN (SELECT feature FROM v GROUP BY feature HAVING count(*) <= 4)""")
def q_categorical_values(spark, sf):
    """T4: the categories of every categorical feature, by successive minima."""
    ft = _ft(spark, sf)
    return stats.bounded_distinct(ft, numeric_features(ft), 4)


@query("accuracy_baseline", f"""{_w('ft')}
SELECT zone, instance, count(*) AS n,
  {O.r(f"avg(CAST((CASE WHEN price_change >= {EPSILON} THEN 2 WHEN price_change <= {-EPSILON} THEN 0 ELSE 1 END) = y_direction AS DOUBLE))", 'accuracy')},
  {O.r(f"1.0 - avg(CAST((CASE WHEN price_change >= {EPSILON} THEN 2 WHEN price_change <= {-EPSILON} THEN 0 ELSE 1 END) = y_direction AS DOUBLE))", 'test_error')}
FROM ft GROUP BY zone, instance""")
def q_accuracy_baseline(spark, sf):
    """Accuracy and test error of the persistence direction forecast, per series."""
    return persistence_accuracy(_ft(spark, sf))


_RMSE_SQL = f"""{_w('ft')},
m AS (SELECT zone, instance, count(*) AS n, sqrt(avg(power(spot_price - y_future_price, 2))) AS rmse,
        stddev_samp(y_future_price) AS label_stddev FROM ft GROUP BY zone, instance)
SELECT zone, instance, n, {O.r('rmse')}, {O.r('label_stddev')}, {O.r('rmse / NULLIF(label_stddev, 0)', 'nrmse')} FROM m"""


@query("rmse_baseline", _RMSE_SQL)
def q_rmse_baseline(spark, sf):
    """RMSE of the persistence price forecast, per series."""
    return persistence_rmse(_ft(spark, sf))


@query("nrmse_baseline", f"""{_w('ft')}
SELECT {O.r('sqrt(avg(power(spot_price - y_future_price, 2))) / NULLIF(stddev_samp(y_future_price), 0)', 'nrmse')} FROM ft""")
def q_nrmse_baseline(spark, sf):
    """RMSE of the persistence forecast over the label's stddev, whole table."""
    return rmse(_ft(spark, sf), "spot_price", "y_future_price").select("nrmse")


@query("auc_baseline", f"""{_w('ft')},
g AS (SELECT zone, instance, price_change AS s, sum(CAST(y_increase > 0.5 AS BIGINT)) AS pos,
        sum(CAST(y_increase <= 0.5 AS BIGINT)) AS neg FROM ft GROUP BY zone, instance, price_change),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY zone, instance ORDER BY s
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT zone, instance, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  {O.r('sum(pos * (below + neg * 0.5)) / NULLIF(sum(pos) * sum(neg), 0)', 'auc')}
FROM c GROUP BY zone, instance""")
def q_auc_baseline(spark, sf):
    """Exact ROC AUC of the current change as a score for the next increase, per series."""
    return momentum_auc(_ft(spark, sf))


_PREPARED = [f for f in _NUM_FEATURES]


def _long_sql(features, label_sql: str = "") -> str:
    rows = " UNION ALL ".join(
        f"SELECT zone, instance, bucket_epoch, {i} AS slot, '{f}' AS feature, {O.r(f'CAST({f} AS DOUBLE)', 'value')}{label_sql} FROM ft"
        for i, f in enumerate(features))
    return f"{_w('ft')}\n{rows}"


@query("assemble", _long_sql(SELECTED_FEATURES))
def q_assemble(spark, sf):
    """The five chosen features assembled into vectors; long form (key, slot, feature, value)."""
    from ..ml.prepare import assembler, long_vectors
    return long_vectors(assembler(list(SELECTED_FEATURES)).transform(_ft(spark, sf)), SELECTED_FEATURES, K)


# A cap table without one instance type in two regions: its series have unknown flags.
_UNCAPPED = "m1.medium"
_UNCAPPED_CAPS = tuple(c for c in PRICE_CAPS if c[1] != _UNCAPPED)


def _prepare_sql() -> str:
    ft = _w("ft")
    rows = " UNION ALL ".join(
        "SELECT zone, instance, bucket_epoch, {i} AS slot, '{f}' AS feature, {v}, CAST(CASE WHEN y_direction > 0.5 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS label FROM ft".format(
            i=i, f=f, v=O.r(f"CAST(CASE WHEN instance = '{_UNCAPPED}' THEN -1 ELSE {f} END AS DOUBLE)" if f == "is_irrational" else f"CAST({f} AS DOUBLE)", "value"))
        for i, f in enumerate(_PREPARED))
    return f"{ft}\n{rows}"


@query("prepare", _prepare_sql())
def q_prepare(spark, sf):
    """(features, binarised label) rows for a classifier, all numeric features, on a table whose
    m1.medium series lack a price cap; long form (key, slot, feature, value, label)."""
    from ..ml.prepare import long_vectors, prepare
    ft = build_features(_ticks(spark, sf), 60, caps=spark.createDataFrame(list(_UNCAPPED_CAPS), CAPS))
    features = numeric_features(ft)
    return long_vectors(prepare(ft, "y_direction", features, keep=K), features, [*K, "label"]).select(*K, "slot", "feature", "value", "label")


# --------------------------------------------------------------------------- models (row checks and tests)
# All registered searches use the full grids of ``schemas``.
_FOREST: dict = {}


def _forest(spark, sf):
    """The hourly random-forest search, run once per session and table for its three queries."""
    from ..ml.models import rf_classifier_search
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FOREST:
        _FOREST.clear()  # one search is kept: leaderboard-sized rows
        _FOREST[key] = rf_classifier_search(_ft(spark, sf), run_id="rf_classifier")
    return _FOREST[key]


@query("rf_classifier_grid")
def q_rf_classifier_grid(spark, sf):
    """Random-forest classifier tree grid on the hourly table; leaderboard."""
    return _forest(spark, sf).board


@query("rf_classifier_purged")
def q_rf_classifier_purged(spark, sf):
    """The same grid on the purged time split: no lag or label of a row it learns from reaches a scored one."""
    from ..ml.models import rf_classifier_search
    return rf_classifier_search(_ft(spark, sf), split="purged", run_id="rf_classifier_purged").board


@query("rf_up_auc")
def q_rf_up_auc(spark, sf):
    """Exact one-vs-rest AUC of the "up" class from the selected forest's probabilities."""
    return _forest(spark, sf).up_auc


@query("rf_importance")
def q_rf_importance(spark, sf):
    """Feature importances of the selected forest, descending."""
    return _forest(spark, sf).importances


@query("mlp_grid")
def q_mlp_grid(spark, sf):
    """M3: multilayer-perceptron grid on the binarised direction; leaderboard."""
    from ..ml.models import mlp_grid
    board, _ = mlp_grid(_ft(spark, sf), run_id="mlp")
    return board


@query("logistic_fit")
def q_logistic_fit(spark, sf):
    """M4: elastic-net logistic regression; objective per iteration."""
    from ..ml.models import logistic_fit
    return logistic_fit(_ft(spark, sf))[0]


@query("logistic_roc")
def q_logistic_roc(spark, sf):
    """M5: ROC curve of the logistic model's training summary."""
    from ..ml.models import logistic_fit
    return logistic_fit(_ft(spark, sf))[1]


@query("logistic_summary")
def q_logistic_summary(spark, sf):
    """M5 / M9: area under the training ROC, test accuracy and iterations of the logistic model."""
    from ..ml.models import logistic_fit
    return logistic_fit(_ft(spark, sf))[2]


@query("gbt_classifier")
def q_gbt_classifier(spark, sf):
    """Boosted-tree classifier, test accuracy and error."""
    from ..ml.models import gbt_classifier
    return gbt_classifier(_ft(spark, sf))


@query("rf_regressor_grid")
def q_rf_regressor_grid(spark, sf):
    """M7: random-forest regressor tree grid, ascending nRMSE."""
    from ..ml.models import rf_regressor_grid
    return rf_regressor_grid(_ft(spark, sf), run_id="rf_regressor")


@query("gbt_regressor_grid")
def q_gbt_regressor_grid(spark, sf):
    """M8: boosted-tree regressor iteration grid, ascending nRMSE; the winner is refitted."""
    from ..ml.models import gbt_regressor_grid
    return gbt_regressor_grid(_ft(spark, sf), run_id="gbt_regressor")


def _hourly(spark, sf):
    return {60: _ft(spark, sf)}


@query("classification_campaign")
def q_classification_campaign(spark, sf):
    """The full random-forest grid for every series of the hourly table, from the
    store by series, through the ledger; leaderboard of the run."""
    from ..ml.campaign import classification_campaign
    return classification_campaign(_hourly(spark, sf), run_id="classification", models=["random_forest_classifier"])


@query("regression_campaign")
def q_regression_campaign(spark, sf):
    """The full random-forest regressor grid for every series of the hourly table."""
    from ..ml.campaign import regression_campaign
    return regression_campaign(_hourly(spark, sf), run_id="regression", models=["random_forest_regressor"])
