"""Running sums over a global order without a task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def prefix_sums(df: DataFrame, order: Sequence[str | Column], values: dict[str, Column], by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """``df`` with, for each name in ``values``, the sum of that value over the rows of the same
    ``by`` group that stand before the row in ``order`` (0 for the first).

    Rows are range-partitioned by (by, order); each partition has its running sums and one
    row of totals per group, and the totals before a partition are joined back. So a group
    with a third of all rows is spread over many tasks, and a window only ever holds one
    partition's rows, or one row per partition. Rows that tie in ``order`` get the sums of
    some order among them. The partitions are checkpointed: sampled range bounds may differ
    when they are computed again, and both the sums and the totals must see the same ones. ``partitions``: how many, else the session decides.
    """
    by, order = list(by), [F.col(c) if isinstance(c, str) else c for c in order]
    taken = set(df.columns)
    part = "_part"
    while part in taken:
        part = f"_{part}"
    held = {name: f"_v{i}_{part}" for i, name in enumerate(values)}
    rows = df.withColumns({held[name]: value for name, value in values.items()})
    ranged = materialize(rows.repartitionByRange(*([partitions] if partitions else []), *[F.col(c) for c in by], *order).withColumn(part, F.spark_partition_id()))
    totals = ranged.groupBy(*by, part).agg(*[F.sum(c).alias(c) for c in held.values()])
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(part).alias(f"{part}_of"), *[F.col(c).alias(f"{part}_{i}") for i, c in enumerate(by)], *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in held.values()]
    )
    inside = Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumns({f"{c}_inside": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in held.values()})
    same = F.col(part) == F.col(f"{part}_of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"{part}_{i}"))
    joined = running.join(offsets, same)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"{held[n]}_before") + F.col(f"{held[n]}_inside")).alias(n) for n in values])


def numbered(df: DataFrame, order: Sequence[str | Column], output: str = "place", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with each row's number in ``order`` (from 1), per ``by`` group. ``order`` must
    tell rows apart for the numbers to be determined."""
    counted = prefix_sums(df, order, {output: F.lit(1).cast("bigint")}, by)
    return counted.withColumn(output, F.col(output) + 1)
