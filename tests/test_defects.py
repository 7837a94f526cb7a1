"""Regression tests for the reference behaviours the rebuild changes on purpose."""

import json
import math
import statistics

import pytest
from pyspark.ml.feature import StringIndexer, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from helpers import BASE, hourly, ticks
from tickfeatures.ml.campaign import _series_tables, classification_campaign, regression_campaign
from tickfeatures.ml.models import SEED, SearchData, gbt_regressor_grid, mlp_grid, rf_classifier_search, rf_regressor_grid
from tickfeatures.operators.split import hash_sample
from tickfeatures.operators.stats import pearson_matrix
from tickfeatures.plans.features import build_features, build_features_all
from tickfeatures.schemas import CAPS, PRICE_CAPS, SELECTED_FEATURES, numeric_features
from tickfeatures.sources.ticks import load_event_ticks


@pytest.fixture(scope="module")
def ft(spark):
    return build_features(load_event_ticks(spark, SF_MID), 60).cache()


def test_d16_building_runs_no_job(spark):
    """The builder is lazy: no Spark job runs until an action."""
    sc = spark.sparkContext
    group = "tickfeatures-lazy-check"
    sc.setJobGroup(group, "build only")
    try:
        ticks = load_event_ticks(spark, SF_SMALL)
        build_features_all(ticks, [15, 30, 60])
        build_features(ticks, 60)
        jobs = sc.statusTracker().getJobIdsForGroup(group)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == []


def test_d14_fraction_one_keeps_every_row(ft):
    assert hash_sample(ft, 1.0).count() == ft.count()
    assert 0 < hash_sample(ft, 0.3).count() < ft.count()


def test_sample_compares_the_whole_hash(ft):
    n = ft.count()
    assert hash_sample(ft, 0.0).count() == 0
    assert 0 < hash_sample(ft, 0.004).count() < 0.008 * n  # not rounded to whole percents
    with pytest.raises(ValueError):
        hash_sample(ft, 1.5)


def test_d9_campaign_filters_each_series(ft):
    tables = {60: ft}
    for interval, zone, instance, subset in _series_tables(tables, 4):
        keys = {(r["zone"], r["instance"]) for r in subset.select("zone", "instance").distinct().collect()}
        assert keys == {(zone, instance)}
    assert len(list(_series_tables(tables, None))) == ft.select("zone", "instance").distinct().count()


def test_d10_label_parameter_is_honoured(ft):
    board = rf_regressor_grid(ft, label="lag_1", features=("spot_price", "lag_2"), trees=(5,)).collect()
    assert {r["label"] for r in board} == {"lag_1"}
    assert board[0]["validation_score"] < 1.0  # lag_2 predicts lag_1 better than the mean


def test_d1_d2_d3_forest_is_ranked_by_auc_and_scored_once(ft):
    found = rf_classifier_search(ft, trees=(5, 10, 20))
    board = found.board.orderBy("rank").collect()
    assert [r["selected"] for r in board] == [True, False, False]
    assert {r["metric"] for r in board} == {"auc_up_vs_rest"}
    assert board[0]["validation_score"] == max(r["validation_score"] for r in board)
    assert [r["test_score"] is not None for r in board] == [True, False, False]
    assert all(0.0 < r["validation_accuracy"] <= 1.0 and 0.0 < r["validation_macro_f1"] <= 1.0 for r in board)
    assert found.up_auc.first()["auc"] == board[0]["test_score"]
    rows = found.predictions.select("y_direction", vector_to_array("probability").alias("p"), "predicted_label").collect()
    assert len({r["p"][0] for r in rows}) > 10  # probabilities, not hard labels


def test_d4_d5_mlp_selects_on_validation(ft):
    one = ft.where((F.col("zone") == "us-west-2a") & (F.col("instance") == "m1.medium"))
    board, preds = mlp_grid(one, hidden=((5, 5), (3,)), max_iters=(5, 20))
    rows = board.collect()
    sizes = {r["n"] for r in preds.select(F.size(vector_to_array("probability")).alias("n")).distinct().collect()}
    assert sizes == {2}
    best = [r for r in rows if r["selected"]]
    assert len(rows) == 4 and len(best) == 1 and best[0]["validation_score"] == max(r["validation_score"] for r in rows)
    right = preds.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert abs(best[0]["test_score"] - right) < 1e-12  # the refitted winner on test


def test_d7_d8_boosted_winner_is_least_error_and_refitted(ft):
    one = ft.where((F.col("zone") == "us-west-2a") & (F.col("instance") == "m1.medium"))
    rows = gbt_regressor_grid(one, iters=(1, 3, 6)).collect()
    best = [r for r in rows if r["selected"]]
    assert len(best) == 1 and best[0]["validation_score"] == min(r["validation_score"] for r in rows)
    n = json.loads(best[0]["params"])["maxIter"]
    with SearchData(one, SELECTED_FEATURES, "y_future_price", index_features=True) as d:
        m = GBTRegressor(labelCol="label", featuresCol="indexed_features", maxIter=n, seed=SEED).fit(d.train_validation)
        mse = m.transform(d.test).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0]
        assert abs(best[0]["test_score"] - math.sqrt(mse) / d.label_spread()) < 1e-12


def test_d11_time_split_keeps_order(ft):
    with SearchData(ft, SELECTED_FEATURES, "y_future_price", split="time") as d:
        edge = {r["part"]: (r["lo"], r["hi"]) for r in d.all.groupBy("part").agg(F.min("bucket_epoch").alias("lo"), F.max("bucket_epoch").alias("hi")).collect()}
    assert edge["train"][1] < edge["validation"][0] <= edge["validation"][1] < edge["test"][0]


def test_d12_indexers_are_fitted_once(ft, monkeypatch):
    fits = []
    for cls in (StringIndexer, VectorIndexer):
        monkeypatch.setattr(cls, "fit", lambda self, *a, f=cls.fit, n=cls.__name__: (fits.append(n), f(self, *a))[1])
    rf_classifier_search(ft, trees=(2, 4, 6))
    assert sorted(fits) == ["StringIndexer", "VectorIndexer"]


def test_d15_fill_is_the_mean_of_the_known_deviations(spark):
    """Rows with another null column (no price cap) still count in the mean."""
    t = load_event_ticks(spark, SF_SMALL)
    caps = spark.createDataFrame([c for c in PRICE_CAPS if c[1] != "c3.large"], CAPS)
    a = build_features(t, 60, caps=caps).select("zone", "instance", "bucket_epoch", "prev_day_std_change", "is_irrational")
    b = build_features(t, 60).select("zone", "instance", "bucket_epoch", "prev_day_std_change")
    assert a.where("is_irrational is null").count() > 0
    assert a.drop("is_irrational").exceptAll(b).count() == 0


def _one_series(spark, prices, zone="us-west-2a"):
    return build_features(ticks(spark, hourly(zone, "m1.medium", BASE, prices)), 60)


def test_flat_series_has_no_score_and_no_winner(spark):
    flat = _one_series(spark, [0.05] * 24 * 6)
    for board in (rf_regressor_grid(flat, trees=(2, 4)), gbt_regressor_grid(flat, iters=(1, 2))):
        rows = board.collect()
        assert len(rows) == 2 and all(r["validation_score"] is None and not r["selected"] and r["test_score"] is None for r in rows)


def test_single_class_has_no_auc(spark):
    rising = _one_series(spark, [0.05 + 0.01 * i for i in range(24 * 6)])
    rows = rf_classifier_search(rising, trees=(2, 4)).board.collect()
    assert all(r["validation_score"] is None and r["validation_accuracy"] == 1.0 and not r["selected"] for r in rows)


def test_series_without_a_cap_keeps_its_rows(spark):
    df = _one_series(spark, [0.05 + 0.01 * (i * i % 11) for i in range(24 * 8)], zone="xx-test-1a")
    assert df.where("is_irrational is null").count() == df.count() > 0
    with SearchData(df, numeric_features(df), "y_direction", binarize=True) as d:
        assert d.all.count() == df.count() and d.skipped == 0
    broken = df.withColumn("lag_1", F.when(F.col("hour") != 3, F.col("lag_1")))
    with SearchData(broken, numeric_features(df), "y_direction") as d:
        assert d.skipped == broken.where("lag_1 is null").count() == df.count() - d.all.count() > 0


def test_campaigns_cover_all_series_and_survive_failures(spark):
    prices = [0.05 + 0.01 * (i * i % 11) for i in range(24 * 8)]
    good = _one_series(spark, prices)
    short = _one_series(spark, prices[:50], zone="us-west-2b").limit(1)
    uncapped = _one_series(spark, prices, zone="xx-test-1a")
    tables = {60: good.unionByName(short).unionByName(uncapped)}
    board = classification_campaign(tables, trees=(2, 4), hidden=((3,),), max_iters=(3,), run_id="r1").collect()
    by = {}
    for r in board:
        by.setdefault((r["zone"], r["model"]), []).append(r)
    assert len(by) == 6 and {r["run_id"] for r in board} == {"r1"}
    for zone in ("us-west-2a", "xx-test-1a"):
        assert sum(r["selected"] for r in by[zone, "multilayer_perceptron"]) == 1
        assert all(r["error"] is None for r in by[zone, "random_forest_classifier"])
    assert any(r["error"] for m in ("random_forest_classifier", "multilayer_perceptron") for r in by["us-west-2b", m])
    board = regression_campaign({60: tables[60]}, n_series=2, trees=(2, 4), iters=(1, 2)).collect()
    assert {r["zone"] for r in board} == {"us-west-2a", "us-west-2b"} and len({r["run_id"] for r in board}) == 1


def test_correlations_use_the_rows_of_each_pair(spark):
    rows = [(float(i), float((i * 7) % 5 + i), float(i % 3) if i % 4 else None, 2.5) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r["feat1"], r["feat2"]): r["corr"] for r in pearson_matrix(df, ["a", "b", "c", "d"]).collect()}

    def want(x, y):
        both = [(r[x], r[y]) for r in rows if r[x] is not None and r[y] is not None]
        mx, my = (statistics.fmean(v) for v in zip(*both))
        sxy = sum((p - mx) * (q - my) for p, q in both)
        return sxy / math.sqrt(sum((p - mx) ** 2 for p, _ in both) * sum((q - my) ** 2 for _, q in both))

    for i, x in enumerate("abc"):
        for j, y in enumerate("abc"):
            assert abs(got[x, y] - want(i, j)) < 1e-12
        assert got[x, "d"] is None and got["d", x] is None
