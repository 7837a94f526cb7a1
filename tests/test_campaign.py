"""Campaigns: series store, ledger, resumed runs; exactly-once leaderboard."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tickfeatures import build_features, ticks_from_events
from tickfeatures.ml import campaign
from tickfeatures.ml.models import LEADERBOARD, failed_board, leaderboard, Score
from tickfeatures.sources.series_store import read_series, stored_series, write_series_store
from tickfeatures.sources.tables import read_leaderboard, write_search


@pytest.fixture(scope="module")
def table(spark):
    return build_features(ticks_from_events(spark.read.parquet(f"{SF_SMALL}/events.parquet")), 60).cache()


def board_of(spark, model, run_id, n=2):
    return leaderboard(spark, model, "y", "auc", [{"numTrees": i} for i in range(n)], [Score(0.5 + i / 10) for i in range(n)], list(range(n))[::-1], 0.6, 0, run_id)


def test_store_reads_one_folder(spark, table, tmp_path):
    path = str(tmp_path / "series")
    write_series_store({60: table}, path)
    series = table.select("zone", "instance").distinct().count()
    assert stored_series(spark, path).count() == series
    one = read_series(spark, path, 60, "us-west-2a", "m1.medium")
    assert len(one.inputFiles()) >= 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "zone" in plan.split("PartitionFilters: [")[1].split("]")[0]
    want = table.where("zone = 'us-west-2a' AND instance = 'm1.medium'")
    assert one.columns == table.columns and one.exceptAll(want).count() == 0 and want.exceptAll(one).count() == 0
    write_series_store({60: table.where("zone = 'us-west-2a'")}, path)  # replaces only these series
    assert stored_series(spark, path).count() == series


def test_leaderboard_written_twice_has_rows_once(spark, tmp_path):
    path = str(tmp_path / "board")
    assert read_leaderboard(spark, path, LEADERBOARD).count() == 0
    for _ in range(2):
        write_search(board_of(spark, "a", "r1"), path)
    write_search(board_of(spark, "b", "r1", 3), path)
    write_search(board_of(spark, "a", "r2", 1), path)
    found = read_leaderboard(spark, path, LEADERBOARD)
    counts = {(r["run_id"], r["model"]): r["count"] for r in found.groupBy("run_id", "model").count().collect()}
    assert counts == {("r1", "a"): 2, ("r1", "b"): 3, ("r2", "a"): 1}
    assert found.schema.fieldNames() == LEADERBOARD.fieldNames() and read_leaderboard(spark, path, LEADERBOARD, "r2").count() == 1


class Killed(BaseException):
    """Ends the campaign like a lost driver, not like a failed search."""


def test_a_killed_run_is_taken_up_again(spark, table, tmp_path):
    store, ledger = str(tmp_path / "series"), str(tmp_path / "ledger")
    write_series_store({60: table}, store)
    calls: list[tuple] = []

    def search(kill_at):
        def run(subset, run_id):
            zone, instance = subset.select("zone", "instance").distinct().first()
            calls.append((zone, instance))
            if len(calls) == kill_at:
                raise Killed
            if instance == "c3.large" and kill_at:
                raise ValueError("a search that fails")
            return board_of(spark, "m", run_id)

        return run

    with pytest.raises(Killed):
        campaign.run_campaign(spark, store, ledger, {"m": search(7)}, "y", parallelism=1, run_id="r")
    first = list(calls)
    done = {tuple(r) for r in campaign.finished_searches(spark, ledger, "r").select("zone", "instance").collect()}
    assert 0 < len(done) < 7 and done < set(first)
    calls.clear()
    board = campaign.run_campaign(spark, store, ledger, {"m": search(None)}, "y", parallelism=1, run_id="r")
    series = {tuple(r) for r in table.select("zone", "instance").distinct().collect()}
    assert set(calls) == series - done and len(calls) == len(set(calls))
    rows = board.groupBy("zone", "instance").agg(F.count("*").alias("n"), F.count("error").alias("errors")).collect()
    assert {(r["zone"], r["instance"]) for r in rows} == series and all(r["n"] == 2 and r["errors"] == 0 for r in rows)
    calls.clear()
    campaign.run_campaign(spark, store, ledger, {"m": search(None)}, "y", run_id="r")
    assert calls == []  # nothing is left to do


def test_failed_searches_are_tried_again(spark, table, tmp_path):
    store, ledger = str(tmp_path / "series"), str(tmp_path / "ledger")
    write_series_store({60: table.where("zone = 'us-west-2a'")}, store)
    fail = campaign.run_campaign(spark, store, ledger, {"m": lambda s, r: 1 / 0}, "y", run_id="r")
    assert {r["error"].split(":")[0] for r in fail.collect()} == {"ZeroDivisionError"} and fail.columns == campaign.CAMPAIGN_BOARD.fieldNames()
    good = campaign.run_campaign(spark, store, ledger, {"m": lambda s, r: board_of(spark, "m", r)}, "y", run_id="r")
    assert good.where("error is not null").count() == 0 and good.count() == 6
    assert failed_board(spark, "m", "y", "x", "r").count() == 1


def test_unknown_model(table):
    with pytest.raises(ValueError):
        campaign.classification_campaign({60: table}, models=["nothing"])
