"""What a search costs the driver and its tasks besides the fits themselves."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tickfeatures.ml.models import (
    LEAST_PARTITIONS,
    SEED,
    TASK_ROWS,
    SearchData,
    _BoostedClassifier,
    _BoostedRegressor,
    _forest_classifier,
    _forest_regressor,
    fit_partitions,
    logistic_fit,
    rf_regressor_grid,
)
from tickfeatures.plans.features import build_features
from tickfeatures.schemas import SELECTED_FEATURES
from tickfeatures.sources.ticks import load_event_ticks


@pytest.fixture(scope="module")
def ft(spark):
    return build_features(load_event_ticks(spark, SF_SMALL), 60).cache()


def test_a_fit_wraps_no_tree_before_it_is_asked_for(ft):
    with SearchData(ft, SELECTED_FEATURES, "y_increase", index_label=True, index_features=True) as d:
        boosted = {"labelCol": "label", "featuresCol": "indexed_features", "maxIter": 2, "seed": SEED}
        for estimator in (_forest_classifier(2, SEED), _forest_regressor(2, SEED), _BoostedClassifier(**boosted), _BoostedRegressor(**boosted)):
            model = estimator.fit(d.train)
            assert "trees" not in vars(model)
            assert len(model.trees) == 2 == model.getNumTrees
            assert model.setPredictionCol("p").transform(d.test).where("p is null").count() == 0


def test_search_data_is_dealt_by_its_size(spark, ft):
    """Few rows keep few partitions in a session of many; the same search data come out."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert fit_partitions(spark, 10) == LEAST_PARTITIONS and fit_partitions(spark, 20 * TASK_ROWS + 1) == 21
        assert fit_partitions(spark, 1000 * TASK_ROWS) == 64
        for split in ("hash", "purged"):
            with SearchData(ft, SELECTED_FEATURES, "y_direction", split=split) as d:
                assert d.all.rdd.getNumPartitions() == LEAST_PARTITIONS
                assert split == "purged" or d.all.count() == ft.count() - d.skipped
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with SearchData(ft, SELECTED_FEATURES, "y_direction") as d:
        assert d.all.rdd.getNumPartitions() == int(before)


def test_fits_do_not_carry_the_feature_table(ft):
    """The plan behind the fits ends at the stored search data."""
    with SearchData(ft, SELECTED_FEATURES, "y_direction", index_features=True) as d:
        plan = d.train._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" in plan and "Window" not in plan and "FileScan" not in plan


def test_a_small_search_is_the_same_in_sessions_of_eight_and_more_partitions(spark, ft):
    """A series' few rows keep eight partitions, so a session's partitions neither add tasks to its fits nor change its forests."""
    one = ft.where("zone = 'us-west-2a' and instance = 'm1.medium'")
    before, boards = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (8, 12, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert fit_partitions(spark, one.count()) == 8
            boards.append(rf_regressor_grid(one, trees=(3, 5), run_id="r").orderBy("params").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert boards[0] == boards[1] == boards[2] and boards[0][0]["validation_score"] > 0


def test_a_logistic_fit_after_an_observed_frame(spark, ft):
    """The session does not go to the tasks: one that has observed a frame cannot be sent."""
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    _, roc, info = logistic_fit(ft)
    assert roc.agg({"tpr": "max"}).first()[0] == 1.0 and 0.0 < info.first()["train_area_under_roc"] <= 1.0
