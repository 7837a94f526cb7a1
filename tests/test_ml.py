import json

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from conftest import SF_MID
from tickfeatures.ml.evaluate import accuracy, auc, rmse
from tickfeatures.ml.models import (
    SEED,
    SPLIT_KEY,
    SearchData,
    _forest_classifier,
    _steps,
    gbt_regressor_grid,
    rf_classifier_grid,
    rf_regressor_grid,
    up_vs_rest_auc,
)
from tickfeatures.ml.prepare import label_index_table
from tickfeatures.operators.split import hash_bucket, with_split
from tickfeatures.plans.features import build_features
from tickfeatures.schemas import RF_TREE_GRID, SELECTED_FEATURES
from tickfeatures.sources.ticks import load_event_ticks


@pytest.fixture(scope="module")
def ft(spark):
    return build_features(load_event_ticks(spark, SF_MID), 60).cache()


def test_hash_split_disjoint_and_complete(ft):
    s = with_split(ft)
    counts = {r["part"]: r["n"] for r in s.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(counts) == {"train", "validation", "test"}
    assert sum(counts.values()) == ft.count()
    assert 0.50 < counts["train"] / ft.count() < 0.62  # 70 % of 80 % = 56 %


def test_hash_bucket_stable_across_partitioning(ft):
    a = ft.select("bucket_epoch", "zone", "instance", hash_bucket().alias("h"))
    b = ft.repartition(3).select("bucket_epoch", "zone", "instance", hash_bucket().alias("h"))
    assert a.exceptAll(b).count() == 0


def test_auc_matches_spark_evaluator(ft):
    df = ft.select(F.col("price_change").alias("s"), F.col("y_increase").alias("y"))
    mine = auc(df, "s", "y").collect()[0]["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", metricName="areaUnderROC", numBins=0)
    assert abs(mine - ev.evaluate(df)) < 1e-12


def test_auc_with_ties_and_buckets(spark):
    rows = [(float(i % 7), float(i % 3 == 0)) for i in range(500)]
    df = spark.createDataFrame(rows, "s double, y double")
    ev = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0)
    for b in (1, 2, 64):
        assert abs(auc(df, "s", "y", buckets=b).collect()[0]["auc"] - ev.evaluate(df)) < 1e-12


def test_accuracy_and_rmse_match_evaluators(ft):
    from pyspark.ml.evaluation import RegressionEvaluator
    df = ft.select(F.col("y_direction").alias("label"), F.lit(2.0).alias("prediction"),
                   "spot_price", "y_future_price")
    acc = accuracy(df, "prediction", "label").collect()[0]["accuracy"]
    assert abs(acc - MulticlassClassificationEvaluator(metricName="accuracy").evaluate(df)) < 1e-12
    r = rmse(df, "spot_price", "y_future_price").collect()[0]["rmse"]
    ev = RegressionEvaluator(labelCol="y_future_price", predictionCol="spot_price", metricName="rmse")
    assert abs(r - ev.evaluate(df)) < 1e-12


def test_label_index_matches_string_indexer(ft):
    model = StringIndexer(inputCol="y_direction", outputCol="i").fit(ft)
    mine = [r["label"] for r in label_index_table(ft, "y_direction").orderBy("label_index").collect()]
    assert mine == list(model.labels)


def test_rf_classifier_leaderboard(ft):
    board, imp, _ = rf_classifier_grid(ft, trees=(10, 20))
    rows = board.collect()
    assert len(rows) == 2 and sum(r["selected"] for r in rows) == 1
    assert all(0.0 <= r["validation_score"] <= 1.0 for r in rows)
    total = sum(r["importance"] for r in imp.collect())
    assert abs(total - 1.0) < 1e-9


def test_nested_forest_votes_like_its_trees(ft):
    """A candidate's score is that of the union of its parts: the votes of all trees, summed."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array

    with SearchData(ft, SELECTED_FEATURES, "y_direction", index_label=True, index_features=True) as d:
        a, b = (_forest_classifier(n, SEED + i).fit(d.train) for i, n in enumerate((3, 4)))
        one = d.validation.limit(50)
        va, vb = (np.array([r["v"] for r in m.transform(one).orderBy(*SPLIT_KEY).select(vector_to_array("rawPrediction").alias("v")).collect()]) for m in (a, b))
        single = [t.transform(one).orderBy(*SPLIT_KEY).select(vector_to_array("probability").alias("v")).collect() for t in (*a.trees, *b.trees)]
        votes = sum(np.array([r["v"] for r in t]) for t in single)
        assert np.allclose(va + vb, votes)
    assert _steps((50, 70, 90)) == [50, 20, 20] and sum(_steps(RF_TREE_GRID)) == 390


def test_nested_and_single_forests_agree(ft):
    """A board's score of a union of forests is that of one forest of its size, within noise."""
    sizes = (2, 3, 40)
    board = {json.loads(r["params"])["numTrees"]: r["validation_score"] for r in rf_classifier_grid(ft, trees=sizes)[0].collect()}
    with SearchData(ft, SELECTED_FEATURES, "y_direction", index_label=True, index_features=True) as d:
        for n, noise in zip(sizes, (0.1, 0.1, 0.02)):
            alone = up_vs_rest_auc(_forest_classifier(n, SEED + 100).fit(d.train).transform(d.validation), "label", d.labels).first()["auc"]
            assert abs(board[n] - alone) < noise, (n, board[n], alone)


def test_search_on_the_purged_split(ft):
    """The parts of a purged search follow one another in each series, with a gap."""
    with SearchData(ft, SELECTED_FEATURES, "y_direction", split="purged") as d:
        span = {
            part: {(r["zone"], r["instance"]): (r["a"], r["b"]) for r in rows.groupBy("zone", "instance").agg(F.min("bucket_epoch").alias("a"), F.max("bucket_epoch").alias("b")).collect()}
            for part, rows in (("train", d.train), ("validation", d.validation), ("test", d.test))
        }
        assert len(span["train"]) == 15
        for series, (_, end) in span["train"].items():
            assert end + 4 * 3600 < span["validation"][series][0]
            assert span["validation"][series][1] + 4 * 3600 < span["test"][series][0]
    rows = rf_classifier_grid(ft, trees=(5, 10), split="purged")[0].collect()
    assert sum(r["selected"] for r in rows) == 1 and all(0.0 < r["validation_score"] < 1.0 for r in rows)


def test_regressor_winner_is_lowest_error(ft):
    one = ft.where((F.col("zone") == "us-west-2a") & (F.col("instance") == "m1.medium"))
    board = rf_regressor_grid(one, trees=(5, 10)).collect()
    best = [r for r in board if r["selected"]][0]
    assert best["validation_score"] == min(r["validation_score"] for r in board)


def test_gbt_each_iteration_equals_separate_fit(spark, ft):
    one = ft.where((F.col("zone") == "us-west-2a") & (F.col("instance") == "m1.medium"))
    board = {json.loads(r["params"])["maxIter"]: r["validation_score"] for r in gbt_regressor_grid(one, iters=(2, 5)).collect()}
    small = {json.loads(r["params"])["maxIter"]: r["validation_score"] for r in gbt_regressor_grid(one, iters=(2,)).collect()}
    assert abs(board[2] - small[2]) < 1e-9


def test_numeric_features_are_27(ft):
    from tickfeatures.schemas import numeric_features
    feats = numeric_features(ft)
    assert len(feats) == 27 and "bucket_epoch" in feats and "y_direction" not in feats


def test_predicted_label_text(ft):
    _, _, preds = rf_classifier_grid(ft, trees=(5,))
    vals = {r["predicted_label"] for r in preds.select("predicted_label").distinct().collect()}
    assert vals <= {"0.0", "1.0", "2.0"}


def test_model_fits_are_reproducible(ft):
    from tickfeatures.ml.models import logistic_fit
    a = [tuple(r) for r in logistic_fit(ft)[0].orderBy("iteration").collect()]
    b = [tuple(r) for r in logistic_fit(ft.repartition(7))[0].orderBy("iteration").collect()]
    assert a == b  # same data in another partitioning: bit-identical objective history


def test_logistic_and_boosted_classifiers(ft):
    from tickfeatures.ml.models import gbt_classifier, logistic_fit

    history, roc, info = logistic_fit(ft)
    assert history.count() > 1 and roc.agg({"tpr": "max"}).first()[0] == 1.0
    row = info.first()
    assert 0.0 <= row["train_area_under_roc"] <= 1.0 and 0.0 < row["test_accuracy"] <= 1.0 and row["skipped_rows"] == 0
    row = gbt_classifier(ft, max_iter=2).first()
    assert 0.5 < row["accuracy"] <= 1.0 and abs(row["accuracy"] + row["test_error"] - 1.0) < 1e-12


def test_prepare_and_assemble(ft):
    from pyspark.ml.functions import vector_to_array
    from tickfeatures.ml.prepare import prepare

    rows = prepare(ft, "y_direction", ["spot_price", "is_irrational"], keep=["y_direction"])
    bad = rows.where((F.col("label") != (F.col("y_direction") > 0.5).cast("double")) | (F.size(vector_to_array("features")) != 2))
    assert rows.count() == ft.count() and bad.count() == 0


def test_searches_leave_nothing_behind(spark, ft):
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    rf_regressor_grid(ft, trees=(2,))
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
