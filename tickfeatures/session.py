"""Session helpers for tests, the benchmark and local runs.

Library code never creates a session: callers pass theirs. On a cluster the
checkpoint folder is whatever ``spark.checkpoint.dir`` names; a local folder is
only set when the setting is absent (tests, local runs).
"""

from __future__ import annotations

import gc
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tickfeatures") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's setting; only a local-mode session
    (tests, local runs) without one gets a fresh local folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError(
            "set spark.checkpoint.dir to a shared folder (a machine-local folder does not survive lost executors)"
        )
    path = tempfile.mkdtemp(prefix="tickfeatures-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint into the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark then deletes the shuffle files of plans that
    nothing refers to any more, else they stay until the driver's heap happens to fill."""
    gc.collect()
    time.sleep(1.1)  # py4j drops the JVM objects that Python has left once a second
    spark.sparkContext._jvm.System.gc()
