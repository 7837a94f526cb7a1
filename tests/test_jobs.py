import os
import tempfile

from conftest import SF_SMALL
from tickfeatures import jobs
from tickfeatures.plans.features import build_features
from tickfeatures.sources.tables import read_feature_table
from tickfeatures.sources.ticks import load_event_ticks, write_ticks_json


def test_build_statistics_quality_jobs(spark):
    base = tempfile.mkdtemp(prefix="tf-jobs-", dir="/tmp")
    ticks = load_event_ticks(spark, SF_SMALL)
    write_ticks_json(ticks, f"{base}/ticks")
    seen = jobs.build(spark, f"{base}/ticks", f"{base}/features")
    stored = spark.read.parquet(f"{base}/features")
    assert seen == {"n_rows": stored.count(), "n_incomplete": 0, "n_hour_mismatch": 0, "n_dow_mismatch": 0, "n_date_mismatch": 0}
    got = sorted(tuple(r) for r in read_feature_table(spark, f"{base}/features", 60).collect())
    want = sorted(tuple(r) for r in build_features(ticks, 60).collect())
    assert got == want  # JSON text round trip of time and price is exact
    jobs.statistics(spark, f"{base}/features", f"{base}/reports")
    for interval in (15, 30, 60):
        for name in ("series", "density"):
            assert len([f for f in os.listdir(f"{base}/reports/{interval}/{name}") if f.startswith("part-")]) == 1
    report = jobs.quality_report(spark, f"{base}/features")
    assert report["schema"].count() == 0 and report["missing_series"].count() == 0
    assert report["domain_lists"].where("domain = 'series'").count() == report["domain_counts"].first()["n_series"] == 15
    assert report["calendar"].first()["n_hour_mismatch"] == 0
    lag = report["lag_lead"].agg({"n_change_mismatch": "max", "n_future_mismatch": "max"}).first()
    assert tuple(lag) == (0, 0)
    assert report["prev_day"].agg({"days_mismatched": "max"}).first()[0] == 0


def test_cli_build_and_quality(spark, capsys):
    base = tempfile.mkdtemp(prefix="tf-cli-", dir="/tmp")
    write_ticks_json(load_event_ticks(spark, SF_SMALL), f"{base}/ticks")
    jobs.main(["build", "--ticks", f"{base}/ticks", "--out", f"{base}/features", "--mode", "chunked"])
    folders = {f for f in os.listdir(f"{base}/features") if f.startswith("interval_min=")}
    assert folders == {"interval_min=15", "interval_min=30", "interval_min=60"}
    jobs.main(["quality", "--features", f"{base}/features", "--out", f"{base}/reports", "--intervals", "30", "60"])
    out = capsys.readouterr().out
    assert "60 lag_lead {'n_change_mismatch': 0, 'n_future_mismatch': 0}" in out
    assert os.path.isdir(f"{base}/reports/30/calendar")


def test_rebuilding_one_interval_keeps_the_others(spark):
    base = tempfile.mkdtemp(prefix="tf-jobs-", dir="/tmp")
    write_ticks_json(load_event_ticks(spark, SF_SMALL), f"{base}/ticks")
    jobs.main(["build", "--ticks", f"{base}/ticks", "--out", f"{base}/features", "--format", "csv", "--intervals", "15", "60"])
    n = read_feature_table(spark, f"{base}/features", 15, "csv").count()
    jobs.main(["build", "--ticks", f"{base}/ticks", "--out", f"{base}/features", "--format", "csv", "--intervals", "60", "--eps", "1000"])
    assert read_feature_table(spark, f"{base}/features", 15, "csv").count() == n > 0
    hourly = read_feature_table(spark, f"{base}/features", 60, "csv")
    assert hourly.count() > 0 and {r[0] for r in hourly.select("y_direction").distinct().collect()} == {1.0}
    assert jobs.quality_report(spark, f"{base}/features", 60, "csv")["schema"].count() == 0


def test_model_jobs_read_csv_and_append(spark):
    base = tempfile.mkdtemp(prefix="tf-jobs-", dir="/tmp")
    write_ticks_json(load_event_ticks(spark, SF_SMALL), f"{base}/ticks")
    jobs.build(spark, f"{base}/ticks", f"{base}/features", [60], fmt="csv")
    args = (spark, f"{base}/features", f"{base}/boards", [60], 1, "csv")
    jobs.classify(*args, trees=(2,), hidden=((3,),), max_iters=(2,))
    jobs.regress(*args, "time", trees=(2,), iters=(1,))
    rows = spark.read.parquet(f"{base}/boards").collect()
    assert len(rows) == 4 and len({r["run_id"] for r in rows}) == 2 and {r["interval_min"] for r in rows} == {60}
