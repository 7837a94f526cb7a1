"""Property tests over random tick sets (few examples: each one runs Spark jobs)."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import ticks
from tickfeatures.operators.resample import resample
from tickfeatures.operators.sequence import shift_columns
from tickfeatures.plans.features import SERIES_WINDOW_KEYS, bucket_table, changes_and_flags, add_lags

SERIES = [("us-west-2a", "m1.medium"), ("eu-west-1b", "c3.large"), ("ap-southeast-1a", "g2.2xlarge")]
START = dt.datetime(2024, 3, 1)

tick = st.tuples(
    st.sampled_from(SERIES),
    st.integers(min_value=0, max_value=4 * 24 * 60),  # minute offset over four days
    st.floats(min_value=0.001, max_value=2.0, allow_nan=False),
)


def _rows(sample):
    return [(z, i, START + dt.timedelta(minutes=m), p) for (z, i), m, p in sample]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(tick, min_size=1, max_size=120))
def test_bucket_mean_within_tick_range(spark, sample):
    t = ticks(spark, _rows(sample))
    res = resample(t, 15).collect()
    by_bucket = {}
    for (z, i), m, p in sample:
        b = (START + dt.timedelta(minutes=m)).replace(tzinfo=dt.timezone.utc).timestamp()
        key = (z, i, int(b) - int(b) % 900)
        by_bucket.setdefault(key, []).append(p)
    assert len(res) == len(by_bucket)
    for r in res:
        ps = by_bucket[(r["zone"], r["instance"], r["bucket_epoch"])]
        assert min(ps) - 1e-12 <= r["spot_price"] <= max(ps) + 1e-12


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(tick, min_size=5, max_size=150), st.integers(min_value=4, max_value=9))
def test_chunked_equals_series_and_one_flag(spark, sample, block_rows):
    base = bucket_table(ticks(spark, _rows(sample)), [60])
    shifts = {"l1": ("spot_price", -1), "l2": ("spot_price", -2), "l3": ("spot_price", -3), "n1": ("spot_price", 1)}
    a = sorted(tuple(r) for r in shift_columns(base, SERIES_WINDOW_KEYS, "bucket_epoch", shifts, "series").collect())
    b = sorted(tuple(r) for r in shift_columns(base, SERIES_WINDOW_KEYS, "bucket_epoch", shifts, "chunked",
                                                chunk_seconds=6 * 3600, block_rows=block_rows).collect())
    assert a == b
    flags = changes_and_flags(add_lags(base), 0.001)
    assert flags.where((F.col("inc_t").cast("int") + F.col("dec_t").cast("int") + F.col("same_t").cast("int")) != 1).count() == 0
