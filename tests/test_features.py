import datetime as dt

from pyspark.sql import functions as F

from helpers import BASE, hourly, ticks
from tickfeatures.functions.pricing import caps_frame, uncovered_series
from tickfeatures.operators.daily import join_previous_day, previous_day_by_range
from tickfeatures.operators.quality import schema_problems
from tickfeatures.plans.features import (
    SERIES_WINDOW_KEYS,
    add_lags,
    bucket_table,
    build_features,
    changes_and_flags,
    with_leads,
)
from tickfeatures.schemas import FEATURES
from tickfeatures.sources.ticks import load_event_ticks, normalize_raw_ticks

from conftest import SF_SMALL


def _ld(t, eps=0.001):
    return with_leads(changes_and_flags(add_lags(bucket_table(t, [60])), eps))


def test_schema_of_feature_table(spark):
    ft = build_features(load_event_ticks(spark, SF_SMALL), 60)
    assert schema_problems(ft, FEATURES) == []
    assert ft.columns == [f.name for f in FEATURES.fields]


def test_epsilon_edges(spark):
    # dyadic prices so the edges are exact: changes +0.5, -0.5, +0.25, -0.25, +0.75, -1.0
    prices = [4.0, 4.0, 4.0, 4.0, 4.5, 4.0, 4.25, 4.0, 4.75, 3.75]
    t = ticks(spark, hourly("us-west-2a", "m1.medium", BASE, prices))
    out = sorted(changes_and_flags(add_lags(bucket_table(t, [60])), 0.5).collect(), key=lambda r: r["bucket_epoch"])
    got = [(r["price_change"], r["inc_t"], r["dec_t"], r["same_t"]) for r in out]
    assert got == [
        (0.0, False, False, True), (0.5, True, False, False), (-0.5, False, True, False),
        (0.25, False, False, True), (-0.25, False, False, True), (0.75, True, False, False),
        (-1.0, False, True, False),
    ]
    for r in out:  # exactly one flag
        assert r["inc_t"] + r["dec_t"] + r["same_t"] == 1


def test_short_series_has_no_rows(spark):
    t = ticks(spark, hourly("us-west-2a", "m1.medium", BASE, [0.1, 0.2, 0.3, 0.4]))
    assert _ld(t).count() == 0


def test_five_buckets_one_day(spark):
    t = ticks(spark, hourly("us-west-2a", "m1.medium", BASE, [0.1, 0.2, 0.3, 0.4, 0.5]))
    assert _ld(t).count() == 1
    assert build_features(t, 60).count() == 0


def test_skipped_day_rows_vanish(spark):
    rows = []
    for day in (1, 2, 4):
        rows += hourly("us-west-2a", "m1.medium", dt.datetime(2024, 1, day, 1), [0.1 + 0.01 * i for i in range(6)])
    ft = build_features(ticks(spark, rows), 60)
    dates = {r["date"] for r in ft.select("date").distinct().collect()}
    assert dates == {dt.date(2024, 1, 2)}


def test_one_row_day_std_filled_with_mean(spark):
    rows = hourly("us-west-2a", "m1.medium", dt.datetime(2024, 1, 1, 10), [0.1, 0.2, 0.15, 0.3, 0.25, 0.2, 0.1])
    # day 2: 3 rows survive; day 3 follows it
    rows += hourly("us-west-2a", "m1.medium", dt.datetime(2024, 1, 2, 21), [0.2, 0.4, 0.3])
    rows += hourly("us-west-2a", "m1.medium", dt.datetime(2024, 1, 3, 5), [0.1, 0.3, 0.2])
    # a second series whose previous day has one surviving row
    rows += hourly("eu-west-1a", "c3.large", dt.datetime(2024, 1, 1, 20), [0.1, 0.2, 0.3, 0.4])
    rows += hourly("eu-west-1a", "c3.large", dt.datetime(2024, 1, 2, 1), [0.6, 0.55, 0.7])
    t = ticks(spark, rows)
    pd_ = join_previous_day(_ld(t), SERIES_WINDOW_KEYS)
    raw = pd_.select("zone", "bucket_epoch", "prev_day_std_change").collect()
    nulls = [r for r in raw if r["prev_day_std_change"] is None]
    present = [r["prev_day_std_change"] for r in raw if r["prev_day_std_change"] is not None]
    assert nulls and present
    mean = sum(present) / len(present)
    ft = build_features(t, 60)
    filled = {(r["zone"], r["bucket_epoch"]): r["prev_day_std_change"] for r in ft.collect()}
    for r in nulls:
        assert abs(filled[(r["zone"], r["bucket_epoch"])] - mean) < 1e-12


def test_unknown_cap_is_null_and_reported(spark):
    rows = hourly("xx-test-1a", "m1.medium", BASE, [0.5] * 3) + hourly("us-west-2a", "m1.medium", BASE, [0.5] * 3)
    t = ticks(spark, rows)
    flags = {r["zone"]: r["is_irrational"] for r in bucket_table(t, [60]).collect()}
    assert flags == {"xx-test-1a": None, "us-west-2a": 1}
    missing = uncovered_series(t, caps_frame(spark)).collect()
    assert [(r["zone"], r["instance"]) for r in missing] == [("xx-test-1a", "m1.medium")]


def test_cap_threshold_is_inclusive(spark):
    t = ticks(spark, [("us-west-2a", "m1.medium", BASE, 0.095), ("us-west-2a", "c3.large", BASE, 0.1199)])
    flags = {r["instance"]: r["is_irrational"] for r in bucket_table(t, [60]).collect()}
    assert flags == {"m1.medium": 1, "c3.large": 0}


def test_one_sided_volatility(spark):
    # day 1 gives a previous-day std; day 2 has one big rise and one big fall
    d1 = hourly("us-west-2a", "m1.medium", dt.datetime(2024, 1, 1, 0), [1.0, 1.1, 1.0, 1.1, 1.0, 1.1, 1.0, 1.1])
    d2 = hourly("us-west-2a", "m1.medium", dt.datetime(2024, 1, 2, 0), [1.0, 3.0, 1.0, 1.05])
    ft = build_features(ticks(spark, d1 + d2), 60).where(F.col("date") == dt.date(2024, 1, 2))
    got = {round(r["price_change"], 6): r["is_volatile"] for r in ft.collect()}
    assert got[2.0] == 1 and got[-2.0] == 0


def test_bad_price_becomes_null(spark):
    raw = spark.createDataFrame(
        [("2016-02-12T05:17:33.000Z", "n/a", "us-west-2a", "m1.medium"),
         ("2016-02-12T05:18:00.000Z", "0.0131", "us-west-2a", "m1.medium"),
         ("garbage", "0.5", "us-west-2a", "m1.medium")],
        "TimeStamp string, SpotPrice string, AvailabilityZone string, InstanceType string",
    )
    out = normalize_raw_ticks(raw).collect()
    assert out[0]["spot_price"] is None and out[1]["spot_price"] == 0.0131
    assert out[0]["ts"] == dt.datetime(2016, 2, 12, 5, 17, 33) and out[2]["ts"] is None
    assert bucket_table(normalize_raw_ticks(raw), [60]).count() == 1


def test_lags_never_cross_series(spark):
    a = hourly("us-west-2a", "m1.medium", BASE, [1.0, 2.0, 3.0, 4.0, 5.0])
    b = hourly("us-west-2a", "c3.large", BASE + dt.timedelta(minutes=30), [10.0, 20.0, 30.0, 40.0, 50.0])
    out = add_lags(bucket_table(ticks(spark, a + b), [60])).collect()
    for r in out:
        for k in ("lag_1", "lag_2", "lag_3"):
            if r[k] is not None:
                assert (r[k] < 9) == (r["spot_price"] < 9)


def test_null_price_bucket_drops_following_rows(spark):
    prices = [1.0, 1.1, 1.2, 1.3, None, 1.5, 1.6, 1.7, 1.8, 1.9, 2.0]
    out = sorted(_ld(ticks(spark, hourly("us-west-2a", "m1.medium", BASE, prices))).collect(),
                 key=lambda r: r["bucket_epoch"])
    hours = [(r["bucket_epoch"] % 86400) // 3600 for r in out]
    # rows 4 (null) and 5-7 (a null lag) go; row 3's next surviving row is row 8
    assert hours == [3, 8, 9]
    assert out[0]["y_future_price"] == 1.8


def test_range_window_equals_join(spark):
    ld = _ld(load_event_ticks(spark, SF_SMALL))
    cols = ["zone", "instance", "bucket_epoch", "prev_day_avg_price", "prev_day_std_change"]
    a = join_previous_day(ld, SERIES_WINDOW_KEYS).select(*cols).collect()
    b = previous_day_by_range(ld, SERIES_WINDOW_KEYS).select(*cols).collect()
    key = lambda r: (r[0], r[1], r[2])
    a, b = sorted(a, key=key), sorted(b, key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert key(x) == key(y)
        assert abs(x[3] - y[3]) < 1e-9
        assert (x[4] is None) == (y[4] is None)
        if x[4] is not None:
            assert abs(x[4] - y[4]) < 1e-9


def _close_rows(a, b, tol=1e-9):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, float):
                assert abs(u - v) <= tol, (x, y)
            else:
                assert u == v, (x, y)


def test_chunked_mode_equals_series_mode(spark):
    t = load_event_ticks(spark, SF_SMALL)
    key = lambda r: (r["zone"], r["instance"], r["bucket_epoch"])
    a = sorted(build_features(t, 15, mode="series").collect(), key=key)
    b = sorted(build_features(t, 15, mode="chunked").collect(), key=key)  # join form for the previous day
    c = sorted(build_features(t, 15, mode="series", prev_day="join").collect(), key=key)
    _close_rows([tuple(r) for r in a], [tuple(r) for r in b])
    _close_rows([tuple(r) for r in b], [tuple(r) for r in c], tol=0.0)


def test_chunked_mode_with_tiny_blocks(spark):
    from tickfeatures.operators.sequence import shift_columns
    prices = [float(i) for i in range(30)]
    rows = hourly("us-west-2a", "m1.medium", BASE, prices, step_hours=5)  # gaps across days
    base = bucket_table(ticks(spark, rows), [60])
    shifts = {"l1": ("spot_price", -1), "l3": ("spot_price", -3), "n1": ("spot_price", 1)}
    a = sorted(tuple(r) for r in shift_columns(base, SERIES_WINDOW_KEYS, "bucket_epoch", shifts, "series").collect())
    b = sorted(tuple(r) for r in shift_columns(base, SERIES_WINDOW_KEYS, "bucket_epoch", shifts, "chunked",
                                                chunk_seconds=7 * 3600, block_rows=4).collect())
    assert a == b


def test_row_loss_contract(spark):
    # per series: first 3 buckets go, then the last, then days without a previous day
    t = load_event_ticks(spark, SF_SMALL)
    bk = bucket_table(t, [60])
    ld = _ld(t)
    n_series = bk.select("zone", "instance").distinct().count()
    assert ld.count() == bk.count() - 4 * n_series
