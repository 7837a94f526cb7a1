"""Plan-shape checks for the properties the design relies on at scale."""

import re

from conftest import SF_SMALL
from tickfeatures.operators.resample import resample
from tickfeatures.plans.features import build_features, build_features_all
from tickfeatures.sources.ticks import load_event_ticks


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_resample_combines_before_the_shuffle(spark):
    plan = _plan(resample(load_event_ticks(spark, SF_SMALL), 60))
    # partial aggregate under the exchange: hot series send one row per bucket per task
    assert re.search(r"HashAggregate\(keys=\[.*functions=\[partial_avg", plan)
    assert plan.count("Exchange hashpartitioning") == 1


def test_scan_reads_only_needed_columns_and_pushes_filters(spark):
    plan = _plan(build_features(load_event_ticks(spark, SF_SMALL), 60))
    schemas = set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))
    assert schemas == {"struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>"}
    assert "PushedFilters: [IsNotNull(ts)]" in plan


def test_windows_share_one_series_shuffle(spark):
    df = build_features_all(load_event_ticks(spark, SF_SMALL), [15, 30, 60])
    plan = _plan(df)
    series_exchanges = re.findall(r"Exchange hashpartitioning\(interval_min#\d+, zone#\d+, instance#\d+, \d+\)", plan)
    # one for the main branch and one for the per-interval fill-mean branch; never one per window
    assert 1 <= len(series_exchanges) <= 2
    assert plan.count("Window [") >= 3
    assert "SortMergeJoin" not in plan


def test_only_bounded_tables_are_broadcast(spark):
    df = build_features(load_event_ticks(spark, SF_SMALL), 60)
    opt = _optimized(df)
    hints = re.findall(r"Hint=\(strategy=broadcast\)", opt)
    # the 9-row cap table (twice: main and fill branches) and the per-interval means
    assert 1 <= len(hints) <= 3


def test_no_copies_of_ticks_below_the_first_aggregate(spark):
    """Several intervals roll up one fine aggregate: ticks are never copied per interval."""
    from tickfeatures.operators.resample import resample_many
    plan = _plan(resample_many(load_event_ticks(spark, SF_SMALL), [15, 30, 60]))
    below = plan[plan.index("Generate explode"):]
    assert plan.count("Generate explode") == 1 and plan.count("FileScan") == 1
    assert "partial_sum" in below and "HashAggregate" in below


def test_row_loss_reads_the_events_once(spark):
    from tickfeatures.operators.quality import row_loss
    assert _plan(row_loss(load_event_ticks(spark, SF_SMALL), 60)).count("FileScan") == 1


def test_domain_counts_do_not_expand_the_rows(spark):
    from tickfeatures.operators.stats import domain_counts
    plan = _plan(domain_counts(load_event_ticks(spark, SF_SMALL)))
    assert "Expand" not in plan and plan.count("FileScan") == 1
