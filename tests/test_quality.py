import datetime as dt

from pyspark.sql import functions as F

from helpers import BASE, hourly, ticks
from tickfeatures.operators import quality
from tickfeatures.plans.features import build_features


def _ft(spark, rows):
    return build_features(ticks(spark, rows), 60)


def _two_days(zone, instance, seed):
    rows = []
    for day in (0, 1, 2):
        rows += hourly(zone, instance, BASE + dt.timedelta(days=day), [0.1 + 0.01 * ((i * seed) % 5) for i in range(8)])
    return rows


def test_completeness_flags_missing_instance(spark):
    rows = _two_days("us-west-2a", "m1.medium", 1) + _two_days("us-west-2a", "c3.large", 2)
    rows += _two_days("eu-west-1a", "m1.medium", 3)  # eu-west-1a lacks c3.large
    got = {r["zone"]: (r["n_instances"], r["n_missing"]) for r in quality.completeness(_ft(spark, rows)).collect()}
    assert got == {"us-west-2a": (2, 0), "eu-west-1a": (1, 1)}


def test_checks_find_injected_errors(spark):
    ft = _ft(spark, _two_days("us-west-2a", "m1.medium", 1))
    assert quality.lag_lead_consistency(ft, 60).first()["n_change_mismatch"] == 0
    assert quality.prev_day_reconciliation(ft).first()["days_mismatched"] == 0
    broken = ft.withColumn("price_change", F.col("price_change") + 1.0).withColumn(
        "prev_day_avg_price", F.col("prev_day_avg_price") * 2).withColumn("hour", F.col("hour") + 1)
    r = quality.lag_lead_consistency(broken, 60).first()
    assert r["n_change_mismatch"] == r["n_with_prev"] > 0
    assert quality.prev_day_reconciliation(broken).first()["days_mismatched"] > 0
    assert quality.calendar_consistency(broken).first()["n_hour_mismatch"] == broken.count()


def test_row_loss_stages_shrink(spark):
    """One pass over marked rows counts what dropping stage by stage leaves."""
    from tickfeatures.operators.daily import join_previous_day
    from tickfeatures.plans.features import SERIES_WINDOW_KEYS, add_lags, bucket_table, changes_and_flags, with_leads
    rows = _two_days("us-west-2a", "m1.medium", 1) + _two_days("eu-west-1a", "c3.large", 3)[:11]
    rows += [("eu-west-1a", "c3.large", None, 0.1)] * 3 + [("us-west-2a", "m1.medium", BASE + dt.timedelta(hours=4), None)]
    rows += [("us-west-2b", "m1.medium", BASE + dt.timedelta(hours=i), None if i == 2 else 0.2) for i in range(6)]
    t = ticks(spark, rows)
    bk = bucket_table(t, [60])
    ch = changes_and_flags(add_lags(bk))
    ld = with_leads(ch)
    pd = join_previous_day(ld, SERIES_WINDOW_KEYS)
    got = [(r["stage_order"], r["stage"], r["rows"]) for r in quality.row_loss(t, 60).orderBy("stage_order").collect()]
    assert got == [(i, s, df.count()) for i, (s, df) in enumerate(zip(quality.ROW_STAGES, (t, bk, ch, ld, pd)))]
    assert [r["rows"] for r in quality.row_loss(t.limit(0), 60).collect()] == [0] * 5


def test_missing_series_and_lists(spark):
    from tickfeatures.operators.stats import domain_counts, domain_lists
    rows = _two_days("us-west-2a", "m1.medium", 1) + _two_days("us-west-2a", "c3.large", 2) + _two_days("eu-west-1a", "m1.medium", 3)
    ft = _ft(spark, rows)
    assert [tuple(r) for r in quality.missing_series(ft).collect()] == [("eu-west-1a", "c3.large")]
    assert tuple(domain_counts(ft).first()) == (2, 2, 3)
    assert domain_lists(ft).count() == 7


def test_fused_pass_equals_single_checks(spark):
    """One scan and one shuffle give the numbers of the seven checks, on a table with faults and nulls."""
    from tickfeatures.operators.stats import domain_counts, domain_lists
    rows = _two_days("us-west-2a", "m1.medium", 1) + _two_days("us-west-2a", "c3.large", 2) + _two_days("eu-west-1a", "m1.medium", 3)
    ft = _ft(spark, rows)
    broken = ft.withColumns({
        "price_change": F.expr("if(hour = 5, price_change + 1, price_change)"),
        "y_future_price": F.expr("if(hour = 4, null, y_future_price * 2)"),
        "prev_day_avg_price": F.expr("case when zone = 'eu-west-1a' then null when instance = 'c3.large' then 7 else prev_day_avg_price end"),
        "iso_dow": F.expr("if(instance = 'c3.large', 9, iso_dow)")})
    lost = ft.limit(3).withColumns({"zone": F.lit(None).cast("string"), "hour": F.lit(None).cast(ft.schema["hour"].dataType)})
    undated = ft.where("hour > 5").withColumns({"date": F.lit(None).cast("date"), "instance": F.lit("undated")})
    for table in (ft, broken, broken.unionByName(lost).unionByName(undated), ft.limit(0)):
        facts = quality.series_facts(table, 60)
        reports = quality.reports_of(facts)
        single = {
            "domain_counts": domain_counts(table), "domain_lists": domain_lists(table),
            "completeness": quality.completeness(table), "missing_series": quality.missing_series(table),
            "prev_day": quality.prev_day_reconciliation(table), "lag_lead": quality.lag_lead_consistency(table, 60),
            "calendar": quality.calendar_consistency(table)}
        assert reports.keys() == single.keys()
        for name, want in single.items():
            assert reports[name].columns == want.columns
            got, want = (sorted((tuple(r) for r in df.collect()), key=repr) for df in (reports[name], want))
            assert got == want, name
    assert facts.collect() == []


def test_fused_pass_has_one_scan_and_one_shuffle(spark, tmp_path):
    _ft(spark, _two_days("us-west-2a", "m1.medium", 1)).write.parquet(f"{tmp_path}/ft")
    plan = quality.series_facts(spark.read.parquet(f"{tmp_path}/ft"), 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_written_rows_are_observed(spark, tmp_path):
    from pyspark.sql import Observation

    from tickfeatures.sources.tables import write_feature_tables
    ft = _ft(spark, _two_days("us-west-2a", "m1.medium", 1) + _two_days("us-west-2a", "c3.large", 2)).withColumn("interval_min", F.lit(60))
    odd = ft.withColumns({"hour": F.expr("if(instance = 'c3.large', hour + 1, hour)"), "price_change": F.expr("if(hour = 7, null, price_change)")})
    seen = Observation()
    write_feature_tables(odd, f"{tmp_path}/out", seen=seen)
    stored = spark.read.parquet(f"{tmp_path}/out")
    want = quality.calendar_consistency(stored).first().asDict()
    got = dict(seen.get)
    assert got.pop("n_incomplete") == stored.count() - stored.dropna().count() > 0
    assert got == want and want["n_hour_mismatch"] == stored.where("instance = 'c3.large'").count() > 0
