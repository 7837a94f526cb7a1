"""Model fits, grid searches and leaderboards.

Every search assembles, indexes and splits its input once (``SearchData``): candidates are
fitted on train and ranked on validation, the winner is refitted on train + validation and
scored once on test. Only leaderboard-sized rows come back to the driver.

A forest grid is nested: the candidate with t trees is the union of forests grown with the
steps between the grid's sizes (independent seeds). Trees of a forest are independent, so
the union is a forest of t trees, and its votes are the sums of its parts' votes: the
whole grid costs as many trees as its largest candidate, and all candidates are scored in
one pass. A boosted grid is one fit: each limit is a prefix of it.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.split import with_purged_split, with_split, with_time_split, with_two_way_split
from ..schemas import (
    GBT_CLASSIFIER_ITERS,
    GBT_REGRESSOR_ITERS,
    LOGISTIC_PARAMS,
    MLP_BLOCK_SIZE,
    MLP_HIDDEN_LAYERS,
    MLP_MAX_ITERS,
    MLP_SEED,
    RF_TREE_GRID,
    SELECTED_FEATURES,
    numeric_features,
)
from ..session import materialize
from .evaluate import auc
from .prepare import assembler, binarizer, complete_rows, feature_indexer, known_flags, label_converter, label_indexer

SEED = 42
PARALLELISM = 4
SPLIT_KEY = ("zone", "instance", "bucket_epoch")
UP = "2.0"
# A label whose standard deviation is below this share of its mean is constant: errors relative to it are noise.
FLAT = 1e-9
TRAIN_SHARE, TRAIN_VALIDATION_SHARE = 0.56, 0.8
# Fits run thousands of short stages over their rows, so the rows go to the session's number of
# partitions only as far as each has TASK_ROWS. Small tables keep up to LEAST_PARTITIONS:
# forests draw their samples by partition, so other partitions give other trees. More would
# cost a small search most of its time: each partition sends the bins of all nodes of a level.
TASK_ROWS = 50_000
LEAST_PARTITIONS = 8

LEADERBOARD = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("params", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("validation_score", T.DoubleType()),
    T.StructField("validation_accuracy", T.DoubleType()),
    T.StructField("validation_macro_f1", T.DoubleType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("selected", T.BooleanType()),
    T.StructField("test_score", T.DoubleType()),
    T.StructField("skipped_rows", T.LongType()),
    T.StructField("error", T.StringType()),
])


def stable_order(df: DataFrame, key: Sequence[str] = SPLIT_KEY, partitions: int | None = None) -> DataFrame:
    """Reproducible partitioning and row order (hash by key, sorted within partitions).
    ``partitions``: how many, else the session decides.

    Shuffle output arrives in no fixed order, and model fitting sums gradients
    and bags rows in partition order, so without this two runs on the same data
    can differ in the last bits (and ROC curves in their number of points).
    """
    return df.repartition(*([partitions] if partitions else []), *key).sortWithinPartitions(*key)


def fit_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for ``rows`` rows of model input: one per ``TASK_ROWS``, at least
    ``LEAST_PARTITIONS``, but no more than the session's."""
    return min(max(LEAST_PARTITIONS, math.ceil(rows / TASK_ROWS)), int(spark.conf.get("spark.sql.shuffle.partitions")))


def _split(df: DataFrame, how: str) -> DataFrame:
    if how == "hash":
        return with_split(df, SPLIT_KEY)
    if how == "time":
        edges = df.approxQuantile("bucket_epoch", [TRAIN_SHARE, TRAIN_VALIDATION_SHARE], 0.001) or [0.0, 0.0]
        return with_time_split(df, "bucket_epoch", int(edges[1]), int(edges[0]))
    if how == "purged":
        return with_purged_split(df, train_share=TRAIN_SHARE, train_validation_share=TRAIN_VALIDATION_SHARE).where(F.col("part") != "purged")
    raise ValueError(f"unknown split {how!r}")


class SearchData:
    """Model input with only the needed columns, assembled, indexed and split once.

    Checkpointed, so that the stages of the fits (thousands) do not each carry the feature
    table's plan to their tasks, and kept on the executors (memory, then disk) while a search
    runs and released by ``close``; a lost block is read again from the checkpoint. ``split``: "hash"
    of the key, "time" (train before validation before test) or "purged" (by time within each
    series, without the rows that share lags or labels with the part behind them). Rows with a null feature or label are left out and
    counted in ``skipped``.
    """

    def __init__(self, df: DataFrame, features: Sequence[str], label: str, *, index_label: bool = False,
                 index_features: bool = False, binarize: bool = False, split: str = "hash", two_way: bool = False):
        features = list(features)
        rows = known_flags(df).select(*SPLIT_KEY, *[c for c in features if c not in SPLIT_KEY], F.col(label).cast("double").alias("_label"))
        ok = complete_rows([*features, "_label"])
        counts = rows.agg(F.count_if(~ok).alias("skipped"), F.count_if(ok).alias("kept")).first()
        self.skipped = int(counts["skipped"])
        partitions = fit_partitions(df.sparkSession, counts["kept"])
        kept = stable_order(rows.where(ok), partitions=partitions)
        parts = with_two_way_split(kept, SPLIT_KEY) if two_way else _split(kept, split)
        if split == "purged":  # its windows deal the rows anew, by series
            parts = parts.repartition(partitions, "zone", "instance").sortWithinPartitions(*SPLIT_KEY)
        out = assembler(features).transform(parts)
        if binarize:
            out = binarizer("_label", "label").transform(out)
        else:
            out = out.withColumn("label", F.col("_label"))
        original = [] if label in ("label", *SPLIT_KEY) else [F.col("_label").alias(label)]
        self.all = materialize(out.select("part", *SPLIT_KEY, *original, "label", "features")).persist(StorageLevel.MEMORY_AND_DISK)
        fit_on = self.all.where(F.col("part") != "test")
        self.labels: list[str] = []
        transformed = self.all
        if index_label:
            model = label_indexer("label", "indexed_label").fit(fit_on)
            self.labels = list(model.labels)
            transformed = model.transform(transformed)
        if index_features:
            transformed = feature_indexer("features", "indexed_features").fit(fit_on).transform(transformed)
        self.train = transformed.where(F.col("part") == "train")
        self.validation = transformed.where(F.col("part") == "validation")
        self.train_validation = transformed.where(F.col("part") != "test")
        self.test = transformed.where(F.col("part") == "test")

    def label_spread(self) -> float | None:
        """Sample standard deviation of the label; None if it is constant or undefined."""
        mean, std = self.all.agg(F.avg("label"), F.stddev_samp("label")).first()
        return std if std is not None and math.isfinite(std) and std > FLAT * max(abs(mean), FLAT) else None

    def close(self) -> None:
        self.all.unpersist()

    def __enter__(self) -> SearchData:
        return self

    def __exit__(self, *_) -> None:
        self.close()


@dataclass(frozen=True)
class Score:
    """A candidate's validation score (None: undefined) and, for classifiers, accuracy and macro-F1."""

    value: float | None
    accuracy: float | None = None
    macro_f1: float | None = None


def _defined(x: float | None) -> float | None:
    return float(x) if x is not None and math.isfinite(x) else None


def ranked(scores: Sequence[Score], larger_is_better: bool) -> list[int]:
    """Candidate numbers from best to worst: ties in grid order, undefined scores last."""
    sign = -1.0 if larger_is_better else 1.0
    return sorted(range(len(scores)), key=lambda i: (scores[i].value is None, sign * (scores[i].value or 0.0), i))


def leaderboard(spark: SparkSession, model: str, label: str, metric: str, grid: Sequence[dict], scores: Sequence[Score],
                order: Sequence[int], test_score: float | None, skipped: int, run_id: str | None) -> DataFrame:
    run_id = run_id or uuid.uuid4().hex
    rank = {i: r + 1 for r, i in enumerate(order)}
    best = order[0] if scores[order[0]].value is not None else None
    rows = [
        (run_id, model, label, json.dumps(p, sort_keys=True), metric, scores[i].value, scores[i].accuracy, scores[i].macro_f1,
         rank[i], i == best, _defined(test_score) if i == best else None, skipped, None)
        for i, p in enumerate(grid)
    ]
    return spark.createDataFrame(rows, LEADERBOARD)


def failed_board(spark: SparkSession, model: str, label: str, message: str, run_id: str | None) -> DataFrame:
    """One row that says why a search gave no result."""
    row = (run_id or uuid.uuid4().hex, model, label, None, None, None, None, None, None, False, None, None, message[:500])
    return spark.createDataFrame([row], LEADERBOARD)


def _class_scores(scored: DataFrame) -> dict[int, Score]:
    """Score per candidate from rows (candidate, label, prediction, score, is_up): the
    one-vs-rest AUC ranks; accuracy and macro-F1 come from the confusion counts."""
    cells = scored.groupBy("candidate", "label", "prediction").agg(F.count(F.lit(1)).alias("n")).collect()  # classes^2 rows each
    areas = {r["candidate"]: r["auc"] for r in auc(scored.where(F.col("score").isNotNull()), "score", "is_up", ("candidate",)).collect()}
    out = {}
    for c in {r["candidate"] for r in cells}:
        own = [r for r in cells if r["candidate"] == c]
        total = sum(r["n"] for r in own)
        hit = {r["label"]: r["n"] for r in own if r["label"] == r["prediction"]}
        f1 = []
        for k in {r["label"] for r in own}:
            wanted = sum(r["n"] for r in own if r["label"] == k)
            given = sum(r["n"] for r in own if r["prediction"] == k)
            f1.append(2.0 * hit.get(k, 0) / (wanted + given))
        out[c] = Score(_defined(areas.get(c)), sum(hit.values()) / total, sum(f1) / len(f1))
    return out


def _each(pool_size: int, items: Sequence, run: Callable) -> list:
    with ThreadPoolExecutor(max_workers=max(1, min(pool_size, len(items)))) as pool:
        return list(pool.map(run, items))


class _LazyTrees:
    """Trees as a property. PySpark lists a new model's parameters by reading all its attributes
    but properties, and ``trees`` is none: each fit would wrap every tree on the driver, which
    takes longer than growing them."""

    @property
    def trees(self):
        return super().trees


class _ForestClassifierModel(_LazyTrees, RandomForestClassificationModel):
    pass


class _ForestRegressorModel(_LazyTrees, RandomForestRegressionModel):
    pass


class _BoostedClassifierModel(_LazyTrees, GBTClassificationModel):
    pass


class _BoostedRegressorModel(_LazyTrees, GBTRegressionModel):
    pass


class _ForestClassifier(RandomForestClassifier):
    def _create_model(self, java_model) -> _ForestClassifierModel:
        return _ForestClassifierModel(java_model)


class _ForestRegressor(RandomForestRegressor):
    def _create_model(self, java_model) -> _ForestRegressorModel:
        return _ForestRegressorModel(java_model)


class _BoostedClassifier(GBTClassifier):
    def _create_model(self, java_model) -> _BoostedClassifierModel:
        return _BoostedClassifierModel(java_model)


class _BoostedRegressor(GBTRegressor):
    def _create_model(self, java_model) -> _BoostedRegressorModel:
        return _BoostedRegressorModel(java_model)


def _steps(sizes: Sequence[int]) -> list[int]:
    """Forest sizes between the grid's sizes, ascending."""
    sizes = sorted(set(sizes))
    return [b - a for a, b in zip([0, *sizes], sizes)]


# --------------------------------------------------------------------------- classifiers
@dataclass(frozen=True)
class ForestSearch:
    board: DataFrame
    importances: DataFrame
    predictions: DataFrame
    up_auc: DataFrame


def _forest_classifier(n: int, seed: int) -> RandomForestClassifier:
    """The features tried per split are named: "auto" would try all of them where a step of a
    nested grid is a single tree."""
    return _ForestClassifier(labelCol="indexed_label", featuresCol="indexed_features", numTrees=n, featureSubsetStrategy="sqrt", seed=seed)


def _up_slot(labels: Sequence[str], up_value: str) -> int | None:
    return list(labels).index(up_value) if up_value in labels else None


def rf_classifier_search(df: DataFrame, label: str = "y_direction", features: Sequence[str] = SELECTED_FEATURES,
                         trees: Sequence[int] = RF_TREE_GRID, parallelism: int = PARALLELISM, split: str = "hash",
                         up_value: str = UP, run_id: str | None = None) -> ForestSearch:
    """Random forest over a tree-count grid, ranked by the one-vs-rest AUC of
    the "up" class on validation. A class that validation lacks leaves the AUC undefined."""
    spark, sizes = df.sparkSession, sorted(set(trees))
    with SearchData(df, features, label, index_label=True, index_features=True, split=split) as data:
        models = _each(parallelism, list(enumerate(_steps(sizes))), lambda s: _forest_classifier(s[1], SEED + s[0]).fit(data.train))
        slot = _up_slot(data.labels, up_value)
        votes = data.validation
        for i, m in enumerate(models):
            votes = m.setPredictionCol(f"_p{i}").setProbabilityCol(f"_q{i}").setRawPredictionCol(f"_v{i}").transform(votes)
        sums, candidates = None, []
        for i, t in enumerate(sizes):
            v = vector_to_array(F.col(f"_v{i}"))
            sums = v if sums is None else F.zip_with(F.col(f"_s{i - 1}"), v, lambda a, b: a + b)
            votes = votes.withColumn(f"_s{i}", sums)
            s = F.col(f"_s{i}")
            score = s[slot] / F.aggregate(s, F.lit(0.0), lambda a, x: a + x) if slot is not None else F.lit(None).cast("double")
            candidates.append(F.struct(F.lit(t).alias("candidate"), (F.array_position(s, F.array_max(s)) - 1).cast("double").alias("prediction"), score.alias("score")))
        scored = votes.select("label", "indexed_label", F.explode(F.array(*candidates)).alias("c")).select(
            "c.candidate", F.col("indexed_label").alias("label"), "c.prediction", "c.score", (F.col("label").cast("string") == up_value).cast("double").alias("is_up"))
        by_size = _class_scores(scored)
        scores = [by_size.get(t, Score(None)) for t in sizes]
        order = ranked(scores, True)
        final = _forest_classifier(sizes[order[0]], SEED).fit(data.train_validation)
        predictions = label_converter(data.labels).transform(final.transform(data.test))  # T5: index -> label text
        up = up_vs_rest_auc(predictions, "label", data.labels, up_value)
        up_rows = up.collect()  # one row
        board = leaderboard(spark, "random_forest_classifier", label, "auc_up_vs_rest", [{"numTrees": t} for t in sizes], scores, order,
                            up_rows[0]["auc"] if up_rows else None, data.skipped, run_id)
        return ForestSearch(board, feature_importances(final.featureImportances, features, spark), predictions,
                            spark.createDataFrame(up_rows, up.schema))


def rf_classifier_grid(df: DataFrame, label: str = "y_direction", features: Sequence[str] = SELECTED_FEATURES,
                       trees: Sequence[int] = RF_TREE_GRID, parallelism: int = PARALLELISM, split: str = "hash",
                       run_id: str | None = None):
    """M1 / M2: (leaderboard, importances, test predictions) of ``rf_classifier_search``."""
    found = rf_classifier_search(df, label, features, trees, parallelism, split, run_id=run_id)
    return found.board, found.importances, found.predictions


def feature_importances(vector, names: Sequence[str], spark: SparkSession) -> DataFrame:
    """Non-zero importances by feature name, descending (k rows for k features)."""
    arr = vector.toArray()
    rows = [(n, float(v)) for n, v in zip(names, arr) if v != 0.0]
    imp = spark.createDataFrame(rows, "feature string, importance double")
    return imp.orderBy(F.desc("importance"), "feature")


def _accuracy(predictions: DataFrame, label: str) -> float | None:
    return predictions.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]


def mlp_grid(df: DataFrame, label: str = "y_direction", features: Sequence[str] | None = None,
             hidden: Sequence[Sequence[int]] = MLP_HIDDEN_LAYERS, max_iters: Sequence[int] = MLP_MAX_ITERS,
             parallelism: int = PARALLELISM, split: str = "hash", run_id: str | None = None):
    """M3: multilayer perceptron over layer shapes x iteration limits on the binarised label,
    ranked by accuracy; the output layer has the two units of a binarised label."""
    feats = list(features) if features is not None else numeric_features(df)
    grid = [{"hidden": list(h), "maxIter": m} for h in hidden for m in max_iters]
    with SearchData(df, feats, label, binarize=True, split=split) as data:

        def fit(p: dict, rows: DataFrame):
            return MultilayerPerceptronClassifier(layers=[len(feats), *p["hidden"], 2], blockSize=MLP_BLOCK_SIZE, seed=MLP_SEED,
                                                  maxIter=p["maxIter"], labelCol="label").fit(rows)

        def run(p: dict) -> Score:
            # one label column: label doubles as the "is up" flag of the binarised task
            rows = fit(p, data.train).transform(data.validation).select(
                F.lit(0).alias("candidate"), "label", "prediction", vector_to_array("probability")[1].alias("score"), F.col("label").alias("is_up"))
            s = _class_scores(rows).get(0, Score(None))
            return Score(s.accuracy, s.accuracy, s.macro_f1)

        scores = _each(parallelism, grid, run)
        order = ranked(scores, True)
        predictions = fit(grid[order[0]], data.train_validation).transform(data.test)
        test = _accuracy(predictions, "label")
        board = leaderboard(df.sparkSession, "multilayer_perceptron", label, "accuracy", grid, scores, order, test, data.skipped, run_id)
        return board, predictions


def logistic_fit(df: DataFrame, label: str = "y_direction", features: Sequence[str] | None = None):
    """M4 / M5: elastic-net logistic regression on the binarised label (70/30 hash split).

    Returns (objective history frame, ROC frame, one-row summary frame).
    """
    feats = list(features) if features is not None else numeric_features(df)
    spark = df.sparkSession
    with SearchData(df, feats, label, binarize=True, two_way=True) as data:
        model = LogisticRegression(**LOGISTIC_PARAMS).fit(data.train)
        summary = model.summary
        # The model goes to the tasks that score; its summary would take the session with it, which
        # cannot be sent once the session has observed a frame.
        model._java_obj.setSummary(spark._jvm.scala.Option.empty())
        history = spark.createDataFrame(
            [(i, float(v)) for i, v in enumerate(summary.objectiveHistory)], "iteration int, objective double"
        )
        # the curve has at most 1000 bins and two ends
        roc = spark.createDataFrame(summary.roc.select(F.col("FPR").alias("fpr"), F.col("TPR").alias("tpr")).collect(), "fpr double, tpr double")
        test_acc = _accuracy(model.transform(data.test), "label")
        info = spark.createDataFrame(
            [(float(summary.areaUnderROC), _defined(test_acc), len(summary.objectiveHistory), data.skipped)],
            "train_area_under_roc double, test_accuracy double, iterations int, skipped_rows bigint",
        )
    return history, roc, info


def gbt_classifier(df: DataFrame, label: str = "y_direction", features: Sequence[str] | None = None,
                   max_iter: int = GBT_CLASSIFIER_ITERS) -> DataFrame:
    """Boosted trees on the binarised label (70/30 hash split): test accuracy and error."""
    feats = list(features) if features is not None else numeric_features(df)
    with SearchData(df, feats, label, binarize=True, two_way=True, index_features=True) as data:
        model = _BoostedClassifier(labelCol="label", featuresCol="indexed_features", maxIter=max_iter, seed=SEED).fit(data.train)
        acc = _defined(_accuracy(model.transform(data.test), "label"))
        return df.sparkSession.createDataFrame([(acc, None if acc is None else 1.0 - acc)], "accuracy double, test_error double")


def up_vs_rest_auc(predictions: DataFrame, label: str, labels: Sequence[str], up_value: str = UP) -> DataFrame:
    """One-vs-rest AUC of the "up" class from the predicted probability (exact, distributed).

    ``labels`` is the fitted label indexer's order (probability slot i is labels[i]). A class
    that the indexer never saw has no score: the result then has no rows.
    """
    slot = _up_slot(labels, up_value)
    score: Column = vector_to_array("probability")[slot] if slot is not None else F.lit(None).cast("double")
    scored = predictions.select(score.alias("score"), (F.col(label).cast("string") == up_value).cast("double").alias("is_up"))
    out = auc(scored, "score", "is_up")
    return out if slot is not None else out.limit(0)


# --------------------------------------------------------------------------- regressors
def _forest_regressor(n: int, seed: int) -> RandomForestRegressor:
    return _ForestRegressor(labelCol="label", featuresCol="indexed_features", numTrees=n, featureSubsetStrategy="onethird", seed=seed)


def _relative(mse: float | None, spread: float | None) -> float | None:
    return _defined(math.sqrt(mse) / spread) if spread and mse is not None else None


def rf_regressor_grid(df: DataFrame, label: str = "y_future_price", features: Sequence[str] = SELECTED_FEATURES,
                      trees: Sequence[int] = RF_TREE_GRID, parallelism: int = PARALLELISM, split: str = "hash",
                      run_id: str | None = None) -> DataFrame:
    """Random-forest regressor over the tree grid, ranked by ascending nRMSE."""
    sizes = sorted(set(trees))
    with SearchData(df, features, label, index_features=True, split=split) as data:
        spread = data.label_spread()
        models = _each(parallelism, list(enumerate(_steps(sizes))), lambda s: _forest_regressor(s[1], SEED + s[0]).fit(data.train))
        rows, total, errors = data.validation, F.lit(0.0), []
        for i, (m, n) in enumerate(zip(models, _steps(sizes))):
            rows = m.setPredictionCol(f"_p{i}").transform(rows)
            total = total + F.lit(float(n)) * F.col(f"_p{i}")
            errors.append(F.avg(F.pow(total / float(sizes[i]) - F.col("label"), 2)))
        mse = rows.agg(*[e.alias(f"e{i}") for i, e in enumerate(errors)]).first()
        scores = [Score(_relative(e, spread)) for e in mse]
        order = ranked(scores, False)
        test = None
        if scores[order[0]].value is not None:
            final = _forest_regressor(sizes[order[0]], SEED).fit(data.train_validation)
            test = _relative(final.transform(data.test).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0], spread)
        return leaderboard(df.sparkSession, "random_forest_regressor", label, "nrmse", [{"numTrees": t} for t in sizes], scores, order, test, data.skipped, run_id)


def gbt_regressor_grid(df: DataFrame, label: str = "y_future_price", features: Sequence[str] = SELECTED_FEATURES,
                       iters: Sequence[int] = GBT_REGRESSOR_ITERS, split: str = "hash", run_id: str | None = None) -> DataFrame:
    """M8: boosted-tree regressor over iteration limits, ranked by ascending nRMSE.

    One fit on train with the largest limit: ``evaluateEachIteration`` on validation gives
    the error after every iteration, which equals a separate fit with that limit (boosting
    is sequential and the seed fixed). The winner is refitted on train + validation.
    """
    with SearchData(df, features, label, index_features=True, split=split) as data:
        spread = data.label_spread()

        def fit(n: int, rows: DataFrame):
            return _BoostedRegressor(labelCol="label", featuresCol="indexed_features", maxIter=n, seed=SEED).fit(rows)

        scores = [Score(None)] * len(iters)
        if spread:
            mse = fit(max(iters), data.train).evaluateEachIteration(data.validation, "squared")
            scores = [Score(_relative(mse[n - 1], spread)) for n in iters]
        order = ranked(scores, False)
        test = None
        if scores[order[0]].value is not None:
            final = fit(iters[order[0]], data.train_validation)
            test = _relative(final.transform(data.test).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0], spread)
        return leaderboard(df.sparkSession, "gbt_regressor", label, "nrmse", [{"maxIter": n} for n in iters], scores, order, test, data.skipped, run_id)
