"""Names that an operator makes for itself: working folders and helper columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Remove a working folder that nothing reads any more, through Spark's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """For each name one that ``columns`` do not have (Spark compares without case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
