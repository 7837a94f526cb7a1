"""Schemas, fixed values and column lists of the feature engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference application's values for the
# results to match. Kept together, in their natural order.
# ---------------------------------------------------------------------------

# Resampling intervals, in minutes.
INTERVALS = (15, 30, 60)

# Threshold of the up / same / down direction labels.
EPSILON = 0.001

# On-demand prices per (region, instance type): a spot price at or above the
# cap is "irrational".
PRICE_CAPS = (
    ("eu-west-1", "m1.medium", 0.095),
    ("eu-west-1", "c3.large", 0.12),
    ("eu-west-1", "g2.2xlarge", 0.702),
    ("us-west-2", "m1.medium", 0.095),
    ("us-west-2", "c3.large", 0.12),
    ("us-west-2", "g2.2xlarge", 0.702),
    ("ap-southeast-1", "m1.medium", 0.117),
    ("ap-southeast-1", "c3.large", 0.132),
    ("ap-southeast-1", "g2.2xlarge", 1.00),
)

# Model search grids.
RF_TREE_GRID = (50, 70, 90, 110, 130, 150, 170, 190, 210, 230, 250, 270, 290, 310, 330, 350, 370, 390)
MLP_HIDDEN_LAYERS = ((5, 5, 5), (10, 10, 10), (5, 5), (10, 10))
MLP_MAX_ITERS = (100, 200, 300, 400)
MLP_BLOCK_SIZE = 128
MLP_SEED = 1234
GBT_REGRESSOR_ITERS = (10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 200, 300, 400)
GBT_CLASSIFIER_ITERS = 10
LOGISTIC_PARAMS = {"maxIter": 10, "regParam": 0.3, "elasticNetParam": 0.8}

# Hand-picked five-feature subset used by the random-forest and regression runs.
SELECTED_FEATURES = ("price_change", "spot_price", "diff_mean_price", "lag_1", "abs_diff_mean_change")

# Classes of the multi-class direction label.
DIRECTION_DOWN, DIRECTION_SAME, DIRECTION_UP, DIRECTION_NONE = 0, 1, 2, 3

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

# Raw JSON-lines ticks. Field names keep the source casing: explicit-schema
# JSON reads match names case-sensitively.
TICK_JSON = T.StructType([
    T.StructField("TimeStamp", T.StringType()),
    T.StructField("SpotPrice", T.StringType()),
    T.StructField("AvailabilityZone", T.StringType()),
    T.StructField("InstanceType", T.StringType()),
])

# Normalised ticks: the input of every builder.
TICKS = T.StructType([
    T.StructField("zone", T.StringType()),
    T.StructField("instance", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("spot_price", T.DoubleType()),
])

CAPS = T.StructType([
    T.StructField("region", T.StringType(), False),
    T.StructField("instance", T.StringType(), False),
    T.StructField("cap", T.DoubleType(), False),
])

SERIES_KEYS = ("zone", "instance")

_I, _D, _L = T.IntegerType(), T.DoubleType(), T.LongType()

FEATURES = T.StructType([
    T.StructField("zone", T.StringType()),
    T.StructField("instance", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("bucket_epoch", _L),
    T.StructField("bucket_ts", T.TimestampNTZType()),
    T.StructField("spot_price", _D),
    T.StructField("hour", _I),
    T.StructField("slot", _I),
    T.StructField("iso_dow", _I),
    T.StructField("is_weekday", _I),
    T.StructField("is_work_6_18", _I),
    T.StructField("is_work_9_17", _I),
    T.StructField("is_work_8_18", _I),
    T.StructField("is_night", _I),
    T.StructField("is_irrational", _I),
    T.StructField("lag_1", _D),
    T.StructField("lag_2", _D),
    T.StructField("lag_3", _D),
    T.StructField("price_change", _D),
    T.StructField("price_change_lag1", _D),
    T.StructField("price_change_lag2", _D),
    T.StructField("y_increase", _D),
    T.StructField("y_decrease", _D),
    T.StructField("y_same", _D),
    T.StructField("y_future_price", _D),
    T.StructField("y_direction", _D),
    T.StructField("prev_day_avg_price", _D),
    T.StructField("prev_day_max_price", _D),
    T.StructField("prev_day_min_price", _D),
    T.StructField("prev_day_avg_change", _D),
    T.StructField("prev_day_max_change", _D),
    T.StructField("prev_day_min_change", _D),
    T.StructField("prev_day_std_change", _D),
    T.StructField("diff_mean_price", _D),
    T.StructField("abs_diff_mean_change", _D),
    T.StructField("is_volatile", _I),
])

FEATURE_COLUMNS = tuple(f.name for f in FEATURES.fields)

LABELS = ("y_increase", "y_decrease", "y_same", "y_direction", "y_future_price")
KEY_COLUMNS = ("zone", "instance", "date", "bucket_ts", "interval_min")

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_features(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Columns that are numeric, not a label and not a key (27 on a feature table)."""
    skip = set(LABELS) | set(KEY_COLUMNS) | set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC) and f.name not in skip]
