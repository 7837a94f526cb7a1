"""Batch jobs: the application's five entry points as commands.

    spark-submit --py-files tickfeatures.zip tickfeatures_job.py build --ticks .../ticks/ --out .../features/
    spark-submit --py-files tickfeatures.zip tickfeatures_job.py statistics --features .../features/ --out .../reports/
    spark-submit --py-files tickfeatures.zip tickfeatures_job.py quality --features .../features/ [--out .../reports/]
    spark-submit --py-files tickfeatures.zip tickfeatures_job.py classify --features .../features/ --out .../boards/
    spark-submit --py-files tickfeatures.zip tickfeatures_job.py regress --features .../features/ --out .../boards/

(``python -m tickfeatures.jobs ...`` runs the same locally.) Cluster settings
(master, checkpoint folder, partitions) come from spark-submit.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import quality, stats
from .plans.features import build_features_all
from .schemas import EPSILON, FEATURES, INTERVALS
from .session import materialize
from .sources.tables import export_single_csv, read_feature_table, series_extract, write_feature_tables
from .sources.ticks import read_ticks_json

# The series exported by the statistics job.
EXPORT_ZONE, EXPORT_INSTANCE = "us-west-2a", "m1.medium"


def build(spark: SparkSession, ticks_path: str, out: str, intervals: Sequence[int] = INTERVALS,
          eps: float = EPSILON, fmt: str = "parquet", mode: str = "series") -> dict[str, int]:
    """Ticks (JSON lines) -> feature tables of all intervals, one scan, one folder per interval.
    Returns the numbers observed on the written rows (see ``write_feature_tables``)."""
    seen = Observation()
    write_feature_tables(build_features_all(read_ticks_json(spark, ticks_path), intervals, eps, mode=mode), out, fmt, seen)
    return seen.get


def statistics(spark: SparkSession, features: str, out: str, intervals: Sequence[int] = INTERVALS, fmt: str = "parquet") -> None:
    """One-series extract and mean daily density per series, as single CSV files per interval."""
    for interval in intervals:
        ft = read_feature_table(spark, features, interval, fmt)
        export_single_csv(series_extract(ft, EXPORT_ZONE, EXPORT_INSTANCE), f"{out}/{interval}/series")
        export_single_csv(stats.density_mean(ft), f"{out}/{interval}/density")


def quality_report(spark: SparkSession, features: str, interval: int = 60, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Data-quality checks over all rows of one interval, as small frames. The rows are read
    once: all checks come from one row per series, kept in the checkpoint folder."""
    problems = quality.stored_schema_problems(spark, features, FEATURES, fmt)
    facts = materialize(quality.series_facts(read_feature_table(spark, features, interval, fmt), interval))
    return {"schema": spark.createDataFrame([(p,) for p in problems], "problem string"), **quality.reports_of(facts)}


def classify(spark: SparkSession, features: str, out: str, intervals: Sequence[int] = (15, 60),
             n_series: int | None = None, fmt: str = "parquet", split: str = "hash", **grids) -> DataFrame:
    """Random-forest and MLP searches per interval and series into a leaderboard folder. With a
    ``run_id`` and ``store`` (folder of the tables by series), a lost run goes on."""
    from .ml.campaign import classification_campaign

    tables = {iv: read_feature_table(spark, features, iv, fmt) for iv in intervals}
    return classification_campaign(tables, n_series, split=split, ledger=out, **grids)


def regress(spark: SparkSession, features: str, out: str, intervals: Sequence[int] = INTERVALS,
            n_series: int | None = None, fmt: str = "parquet", split: str = "hash", **grids) -> DataFrame:
    """Random-forest and boosted-tree regressor searches per interval and series."""
    from .ml.campaign import regression_campaign

    tables = {iv: read_feature_table(spark, features, iv, fmt) for iv in intervals}
    return regression_campaign(tables, n_series, split=split, ledger=out, **grids)


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tickfeatures.jobs")
    sub = p.add_subparsers(dest="job", required=True)
    b = sub.add_parser("build")
    b.add_argument("--ticks", required=True)
    b.add_argument("--mode", default="series", choices=["series", "chunked"])
    b.add_argument("--eps", type=float, default=EPSILON)
    for name in ("build", "statistics", "quality", "classify", "regress"):
        s = b if name == "build" else sub.add_parser(name)
        if name != "build":
            s.add_argument("--features", required=True)
        s.add_argument("--out", required=name != "quality")
        s.add_argument("--format", default="parquet", choices=["parquet", "csv"])
        s.add_argument("--intervals", type=int, nargs="+", default=[15, 60] if name == "classify" else list(INTERVALS))
        if name in ("classify", "regress"):
            s.add_argument("--n-series", type=int, default=None, help="only the first n series (default: all)")
            s.add_argument("--split", default="hash", choices=["hash", "time", "purged"])
            s.add_argument("--run-id", default=None, help="take up this run's unfinished searches")
            s.add_argument("--store", default=None, help="folder of the tables by series, kept for later runs")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"tickfeatures-{a.job}").getOrCreate()
    if a.job == "build":
        build(spark, a.ticks, a.out, a.intervals, a.eps, fmt=a.format, mode=a.mode)
    elif a.job == "statistics":
        statistics(spark, a.features, a.out, a.intervals, a.format)
    elif a.job == "quality":
        for interval in a.intervals:
            for name, df in quality_report(spark, a.features, interval, a.format).items():
                print(interval, name, _worst(df))
                if a.out:
                    df.coalesce(1).write.mode("overwrite").parquet(f"{a.out}/{interval}/{name}")
    elif a.job == "classify":
        classify(spark, a.features, a.out, a.intervals, a.n_series, a.format, a.split, run_id=a.run_id, store=a.store)
    elif a.job == "regress":
        regress(spark, a.features, a.out, a.intervals, a.n_series, a.format, a.split, run_id=a.run_id, store=a.store)


def _worst(df: DataFrame) -> dict:
    """The greatest mismatch counts of a check, or the number of its rows."""
    bad = [c for c in df.columns if "mismatch" in c or c == "n_missing"]
    return df.agg(*[F.max(c).alias(c) for c in bad]).first().asDict() if bad else {"rows": df.count()}


if __name__ == "__main__":
    main()
