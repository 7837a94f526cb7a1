import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import BASE, ticks
from tickfeatures.functions.time import bucket_start, epoch_seconds, iso_day_of_week, slot_in_hour
from tickfeatures.operators.resample import resample, resample_many
from tickfeatures.plans.features import bucket_table


def test_bucket_edges(spark):
    minutes = [0, 14, 15, 29, 30, 44, 45, 59]
    rows = [("us-west-2a", "m1.medium", BASE + dt.timedelta(hours=5, minutes=m), 1.0) for m in minutes]
    df = ticks(spark, rows).select(epoch_seconds("ts").alias("e"))
    got = {}
    for iv in (15, 30, 60):
        got[iv] = [r[0] for r in df.select(slot_in_hour(bucket_start("e", iv), iv)).collect()]
    assert got[15] == [1, 1, 2, 2, 3, 3, 4, 4]
    assert got[30] == [1, 1, 1, 1, 2, 2, 2, 2]
    assert got[60] == [1] * 8


def test_resample_mean_within_min_max(spark):
    rows = [("us-west-2a", "m1.medium", BASE + dt.timedelta(minutes=m), float(p))
            for m, p in [(1, 1), (2, 2), (3, 6), (16, 4)]]
    out = sorted(resample(ticks(spark, rows), 15).collect(), key=lambda r: r["bucket_epoch"])
    assert [r["spot_price"] for r in out] == [3.0, 4.0]
    assert out[1]["bucket_epoch"] - out[0]["bucket_epoch"] == 900


def test_resample_many_equals_single(spark):
    t = ticks(spark, [("us-west-2a", "m1.medium", BASE + dt.timedelta(minutes=7 * i), float(i)) for i in range(40)])
    many = resample_many(t, [15, 60], ("zone", "instance"))
    for iv in (15, 60):
        a = sorted(tuple(r) for r in resample(t, iv).collect())
        b = sorted(tuple(r) for r in many.where(F.col("interval_min") == iv).drop("interval_min").collect())
        assert a == b


def test_week_and_hour_edges(spark):
    sunday = dt.datetime(2024, 1, 7, 5)
    monday = dt.datetime(2024, 1, 8, 5)
    rows = [("us-west-2a", "m1.medium", d + dt.timedelta(hours=h), 0.01) for d in (sunday, monday)
            for h in [0, 1, 2, 3, 4, 5, 11, 12, 13, 14]]  # hours 5-10 and 16-19
    out = bucket_table(ticks(spark, rows), [60]).collect()
    by_hour = {}
    for r in out:
        by_hour.setdefault(r["hour"], r)
        if r["date"] == dt.date(2024, 1, 7):
            assert (r["iso_dow"], r["is_weekday"]) == (7, 0)
        else:
            assert (r["iso_dow"], r["is_weekday"]) == (1, 1)
    expect = {  # hour: (6-18, 9-17, 8-18, night)
        5: (0, 0, 0, 1), 6: (1, 0, 0, 1), 7: (1, 0, 0, 0), 8: (1, 0, 1, 0), 9: (1, 1, 1, 0), 10: (1, 1, 1, 0),
        16: (1, 1, 1, 0), 17: (1, 1, 1, 0), 18: (1, 0, 1, 0), 19: (0, 0, 0, 0),
    }
    for h, flags in expect.items():
        r = by_hour[h]
        assert (r["is_work_6_18"], r["is_work_9_17"], r["is_work_8_18"], r["is_night"]) == flags, h


def test_iso_dow_matches_spark_weekday(spark):
    df = spark.range(0, 400).select((F.col("id") * 86400 + 3600).alias("e"))
    bad = df.where(iso_day_of_week("e") != (F.weekday(F.timestamp_seconds("e")) + 1)).count()
    assert bad == 0


def test_timezone_independent(spark):
    t = ticks(spark, [("us-west-2a", "m1.medium", dt.datetime(2024, 1, 1, 23, 30), 1.0)])
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        r = bucket_table(t, [60]).collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert (r["date"], r["hour"], r["bucket_ts"]) == (dt.date(2024, 1, 1), 23, dt.datetime(2024, 1, 1, 23, 0))


def test_legacy_key_groups_and_orders_like_bucket_start(spark):
    from tickfeatures.functions.time import legacy_bucket_key
    from tickfeatures.sources.ticks import load_event_ticks
    from conftest import SF_SMALL
    t = load_event_ticks(spark, SF_SMALL)
    for iv in (15, 30, 60):
        r = resample(t, iv).withColumn("k", legacy_bucket_key("bucket_epoch", iv))
        assert r.select("zone", "instance", "k").distinct().count() == r.count()
        # same order: within a series the key rises strictly with the bucket start
        w = Window.partitionBy("zone", "instance").orderBy("bucket_epoch")
        assert r.withColumn("prev_k", F.lag("k").over(w)).where(F.col("k") <= F.col("prev_k")).count() == 0
    # 05:17:33 at 15 minutes: slot 2 -> hour start + 2 minutes
    one = ticks(spark, [("us-west-2a", "m1.medium", BASE + dt.timedelta(hours=5, minutes=17, seconds=33), 1.0)])
    k = resample(one, 15).select(legacy_bucket_key("bucket_epoch", 15)).first()[0]
    assert k == int((BASE + dt.timedelta(hours=5, minutes=2)).replace(tzinfo=dt.timezone.utc).timestamp())
