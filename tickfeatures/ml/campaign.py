"""Per-(interval, series) model campaigns with one leaderboard.

The feature tables are stored by series first (``sources.series_store``), so each search
reads one folder. The leaderboard folder is also the campaign's ledger: a search writes its
rows into a folder of its own (run, interval, series, model), replacing what is there. A
campaign first looks for the searches of its run that are finished there (an anti join) and
runs the others only, so a run that was lost half-way is taken up again by calling it with
the same folders and run_id, and no search has its rows twice.

All series by default; ``n_series`` takes the first n in (zone, instance) order instead.
The loop runs over the list of searches only; each one is distributed. Searches run side by
side, each series in a scheduler pool of its own: with ``spark.scheduler.mode=FAIR`` the
jobs of a long search do not hold up the others. A search that fails becomes an error row
of the leaderboard; the others go on, and a resumed run tries it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import top_n_series
from ..schemas import (
    GBT_REGRESSOR_ITERS,
    MLP_HIDDEN_LAYERS,
    MLP_MAX_ITERS,
    RF_TREE_GRID,
    SELECTED_FEATURES,
    SERIES_KEYS,
    numeric_features,
)
from ..session import ensure_checkpoint_dir
from ..sources.series_store import read_series, read_series_store, stored_series, write_series_store
from ..sources.tables import read_leaderboard, write_search
from .models import LEADERBOARD, failed_board, gbt_regressor_grid, mlp_grid, rf_classifier_search, rf_regressor_grid

# Concurrent (interval, series) searches; each one is a chain of small distributed jobs.
CAMPAIGN_PARALLELISM = 6

CAMPAIGN_BOARD = T.StructType([T.StructField("interval_min", T.IntegerType()), T.StructField("zone", T.StringType()), T.StructField("instance", T.StringType()), *LEADERBOARD.fields])
SEARCH_KEY = ("interval_min", "zone", "instance", "model")

Search = Callable[[DataFrame, str], DataFrame]


def wanted_searches(spark: SparkSession, store: str, models: Sequence[str], n_series: int | None = None) -> DataFrame:
    """``interval_min, zone, instance, model`` of a campaign over the stored series."""
    series = stored_series(spark, store)
    if n_series is not None:
        series = series.join(F.broadcast(top_n_series(series, n_series)), list(SERIES_KEYS), "left_semi")
    return series.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def finished_searches(spark: SparkSession, ledger: str, run_id: str) -> DataFrame:
    """Searches of the run that have rows without an error."""
    return read_leaderboard(spark, ledger, CAMPAIGN_BOARD, run_id).where(F.col("error").isNull()).select(*SEARCH_KEY).distinct()


def run_campaign(spark: SparkSession, store: str, ledger: str, searches: Mapping[str, Search], label: str, n_series: int | None = None,
                 parallelism: int = CAMPAIGN_PARALLELISM, run_id: str | None = None, intervals: Sequence[int] | None = None) -> DataFrame:
    """Run the unfinished searches of a run over the stored series; the run's leaderboard."""
    run_id = run_id or uuid.uuid4().hex
    wanted = wanted_searches(spark, store, list(searches), n_series)
    if intervals is not None:
        wanted = wanted.where(F.col("interval_min").isin(list(intervals)))
    todo = wanted.join(finished_searches(spark, ledger, run_id), list(SEARCH_KEY), "left_anti").orderBy(*SEARCH_KEY).collect()  # one row per search

    def one(task: Row) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"series-{task['interval_min']}-{task['zone']}-{task['instance']}")
        subset = read_series(spark, store, task["interval_min"], task["zone"], task["instance"])
        try:
            board = searches[task["model"]](subset, run_id)
        except Exception as e:  # one series must not end the campaign
            board = failed_board(spark, task["model"], label, f"{type(e).__name__}: {e}".splitlines()[0], run_id)
        board = board.select(*[F.lit(task[c]).alias(c) for c in ("interval_min", *SERIES_KEYS)], *LEADERBOARD.fieldNames())
        write_search(board, ledger)

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(todo)))) as pool:
        list(pool.map(one, todo))
    keys = wanted.select(*SEARCH_KEY)
    return read_leaderboard(spark, ledger, CAMPAIGN_BOARD, run_id).join(F.broadcast(keys), list(SEARCH_KEY), "left_semi").select(*CAMPAIGN_BOARD.fieldNames())


def _series_tables(tables: Mapping[int, DataFrame], n_series: int | None) -> Iterator[tuple[int, str, str, DataFrame]]:
    """(interval, zone, instance, rows of that series) for all or the first ``n_series`` series,
    read from a store by series."""
    spark = next(iter(tables.values())).sparkSession
    store = f"{ensure_checkpoint_dir(spark).rstrip('/')}/series-{uuid.uuid4().hex}"
    write_series_store(tables, store)
    for r in wanted_searches(spark, store, [""], n_series).orderBy(*SEARCH_KEY).collect():
        yield r["interval_min"], r["zone"], r["instance"], read_series(spark, store, r["interval_min"], r["zone"], r["instance"])


def _run(tables: Mapping[int, DataFrame], n_series: int | None, searches: Mapping[str, Search], label: str, parallelism: int, run_id: str | None,
         store: str | None, ledger: str | None) -> DataFrame:
    """Store the tables (once per store and interval) and run the campaign over them."""
    if not tables:
        raise ValueError("no tables")
    spark = next(iter(tables.values())).sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/campaign-{uuid.uuid4().hex}"
    if store is None:
        store = f"{folder}/series"
        write_series_store(tables, store)
    else:
        there = set()
        if _exists(spark, store):
            there = {r["interval_min"] for r in read_series_store(spark, store).select("interval_min").distinct().collect()}
        if missing := {i: t for i, t in tables.items() if i not in there}:
            write_series_store(missing, store)
    return run_campaign(spark, store, ledger or f"{folder}/ledger", searches, label, n_series, parallelism, run_id, list(tables))


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _chosen(searches: Mapping[str, Search], models: Sequence[str] | None) -> dict[str, Search]:
    if models is None:
        return dict(searches)
    if unknown := set(models) - set(searches):
        raise ValueError(f"unknown models: {sorted(unknown)}")
    return {m: searches[m] for m in models}


def classification_campaign(tables: Mapping[int, DataFrame], n_series: int | None = None, label: str = "y_direction",
                            trees: Sequence[int] = RF_TREE_GRID,
                            hidden: Sequence[Sequence[int]] = MLP_HIDDEN_LAYERS,
                            max_iters: Sequence[int] = MLP_MAX_ITERS,
                            parallelism: int = CAMPAIGN_PARALLELISM, split: str = "hash", run_id: str | None = None,
                            models: Sequence[str] | None = None, store: str | None = None, ledger: str | None = None) -> DataFrame:
    """Random forest (5 chosen features) and MLP (all numeric features) per interval and series.

    ``store`` and ``ledger``: folders to keep, which a later call with the same ``run_id``
    takes up; by default new ones in the checkpoint folder. Intervals that ``store`` has are
    not written again."""
    searches = {
        "random_forest_classifier": lambda s, r: rf_classifier_search(s, label, SELECTED_FEATURES, trees, split=split, run_id=r).board,
        "multilayer_perceptron": lambda s, r: mlp_grid(s, label, numeric_features(s), hidden, max_iters, split=split, run_id=r)[0],
    }
    return _run(tables, n_series, _chosen(searches, models), label, parallelism, run_id, store, ledger)


def regression_campaign(tables: Mapping[int, DataFrame], n_series: int | None = None, label: str = "y_future_price",
                        trees: Sequence[int] = RF_TREE_GRID, iters: Sequence[int] = GBT_REGRESSOR_ITERS,
                        parallelism: int = CAMPAIGN_PARALLELISM, split: str = "hash", run_id: str | None = None,
                        models: Sequence[str] | None = None, store: str | None = None, ledger: str | None = None) -> DataFrame:
    """Random-forest and boosted-tree regressors per interval and series (filtered, unlike
    D9); ``store`` and ``ledger`` as in ``classification_campaign``."""
    searches = {
        "random_forest_regressor": lambda s, r: rf_regressor_grid(s, label, SELECTED_FEATURES, trees, split=split, run_id=r),
        "gbt_regressor": lambda s, r: gbt_regressor_grid(s, label, SELECTED_FEATURES, iters, split=split, run_id=r),
    }
    return _run(tables, n_series, _chosen(searches, models), label, parallelism, run_id, store, ledger)
