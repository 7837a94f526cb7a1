import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tickfeatures.plans.features import build_features, build_features_all
from tickfeatures.sources.tables import export_single_csv, read_feature_table, series_extract, write_feature_tables
from tickfeatures.sources.ticks import load_event_ticks, read_ticks_json


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_parquet_and_csv_roundtrip(spark):
    t = load_event_ticks(spark, SF_SMALL)
    allf = build_features_all(t, [15, 60])
    for fmt in ("parquet", "csv"):
        path = tempfile.mkdtemp(prefix="tf-io-", dir="/tmp") + "/ft"
        write_feature_tables(allf, path, fmt)
        assert sorted(os.listdir(path))[:2] == ["_SUCCESS", "interval_min=15"] or "interval_min=60" in os.listdir(path)
        back = read_feature_table(spark, path, 60, fmt)
        assert _rows(back) == _rows(build_features(t, 60))


def test_single_file_export(spark):
    ft = build_features(load_event_ticks(spark, SF_SMALL), 60)
    path = tempfile.mkdtemp(prefix="tf-io-", dir="/tmp") + "/series"
    export_single_csv(series_extract(ft, "us-west-2a", "m1.medium"), path)
    parts = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(parts) == 1


def test_read_ticks_json(spark):
    path = tempfile.mkdtemp(prefix="tf-io-", dir="/tmp") + "/ticks.json"
    with open(path, "w") as f:
        f.write('{"TimeStamp": "2016-02-12T05:17:33.000Z", "SpotPrice": "0.0131", '
                '"AvailabilityZone": "us-west-2a", "InstanceType": "m1.medium", "Other": 1}\n')
        f.write('{"TimeStamp": "2016-02-12T05:47:00.000Z", "SpotPrice": "n/a", '
                '"AvailabilityZone": "us-west-2a", "InstanceType": "m1.medium"}\n')
    t = read_ticks_json(spark, path)
    rows = t.collect()
    assert [r["spot_price"] for r in rows] == [0.0131, None]
    assert t.where(F.col("ts").isNull()).count() == 0


def test_views_and_leaderboard_sink(spark):
    from tickfeatures.sources.tables import register_views, write_leaderboard
    ft = build_features(load_event_ticks(spark, SF_SMALL), 60)
    register_views(spark, {"ft_view_test": ft})
    assert spark.sql("SELECT count(*) AS n FROM ft_view_test").collect()[0]["n"] == ft.count()
    path = tempfile.mkdtemp(prefix="tf-io-", dir="/tmp") + "/boards"
    board = spark.createDataFrame([("m", 1.0)], "model string, score double")
    write_leaderboard(board, path)
    write_leaderboard(board, path)
    assert spark.read.parquet(path).count() == 2


def test_long_series_spans_several_files(spark):
    from helpers import BASE, hourly, ticks
    rows = hourly("us-west-2a", "m1.medium", BASE, [0.1 + (i % 7) * 0.01 for i in range(24 * 150)])
    rows += hourly("eu-west-1a", "c3.large", BASE, [0.2, 0.21, 0.22, 0.23, 0.24, 0.25] * 8)
    allf = build_features_all(ticks(spark, rows), [60])
    path = tempfile.mkdtemp(prefix="tf-io-", dir="/tmp") + "/ft"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_feature_tables(allf, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = [f for f in os.listdir(path + "/interval_min=60") if f.endswith(".parquet")]
    assert len(files) > 2
    assert _rows(read_feature_table(spark, path, 60)) == _rows(allf.drop("interval_min"))
