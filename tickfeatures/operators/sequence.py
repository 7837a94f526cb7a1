"""Lag / lead over each series ordered by bucket.

Two plans with the same result:

* ``series`` (default): one ``Window.partitionBy(series).orderBy(bucket)``, one
  shuffle, and the lag and lead windows share it. After resampling a series has
  at most (time span / interval) rows however many ticks it had (35k rows per
  year at 15 minutes), so even a series that had a third of all ticks is a
  bounded, streaming window task; skew in ticks is absorbed by the map-side
  partial aggregation of the resample.
* ``chunked``: for very long histories or very few series. Rows get their exact
  position in the series from a per-(series, day) row number plus a running
  count of earlier days (a table of one row per series-day). Positions are cut
  into fixed-size blocks, and each block receives copies of the few rows just
  before / after it (the halo). The window then runs per (series, block), so no
  task holds more than ``block_rows`` + halo rows of a series. It costs two more
  shuffles of the resampled table (about 3x the time at sf0.1 locally).

Lag means "previous observed bucket": empty buckets do not exist and nothing
is filled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A shift is (input column, offset): negative offsets look back (lag),
# positive offsets look ahead (lead).
Shifts = Mapping[str, tuple[str, int]]

DEFAULT_CHUNK_SECONDS = 86400
DEFAULT_BLOCK_ROWS = 100_000


def shift_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    shifts: Shifts,
    mode: str = "series",
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Add one column per shift: ``out = in`` taken ``offset`` rows away within the series."""
    if mode == "series":
        return _shift_series(df, keys, order, shifts)
    if mode == "chunked":
        return _shift_chunked(df, keys, order, shifts, chunk_seconds, block_rows)
    raise ValueError(f"unknown mode {mode!r}")


def _shift_expr(w, src: str, offset: int):
    return F.lead(src, offset).over(w) if offset > 0 else F.lag(src, -offset).over(w)


def _shift_series(df: DataFrame, keys: Sequence[str], order: str, shifts: Shifts) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({out: _shift_expr(w, src, off) for out, (src, off) in shifts.items()})


def series_positions(
    df: DataFrame, keys: Sequence[str], order: str, chunk_seconds: int = DEFAULT_CHUNK_SECONDS
) -> DataFrame:
    """Add ``_pos``: the exact 1-based row number of each row in its series.

    Computed without a window over the whole series: a row number inside each
    (series, chunk of ``order``) plus the number of rows in earlier chunks.
    """
    chunk = F.floor(F.col(order) / F.lit(chunk_seconds)).cast("long")
    ranked = df.withColumn("_chunk", chunk).withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(order))
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranked.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        ranked.join(offsets, [*keys, "_chunk"], "inner")
        .withColumn("_pos", (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_chunk", "_local", "_before")
    )


def _shift_chunked(
    df: DataFrame, keys: Sequence[str], order: str, shifts: Shifts, chunk_seconds: int, block_rows: int
) -> DataFrame:
    back = max([-o for _, o in shifts.values() if o < 0], default=0)
    ahead = max([o for _, o in shifts.values() if o > 0], default=0)
    if block_rows <= max(back, ahead):
        raise ValueError("block_rows must exceed the largest shift")
    pos = series_positions(df, keys, order, chunk_seconds)
    idx = F.col("_pos") - 1
    block = F.floor(idx / F.lit(block_rows)).cast("long")
    within = F.pmod(idx, F.lit(block_rows))
    copies = [F.struct(block.alias("_block"), F.lit(True).alias("_home"))]
    if back:  # the last rows of a block are looked back at by the next block
        copies.append(F.when(within >= block_rows - back, F.struct((block + 1).alias("_block"), F.lit(False).alias("_home"))))
    if ahead:  # the first rows of a block are looked ahead at by the previous block
        copies.append(F.when((within < ahead) & (block > 0), F.struct((block - 1).alias("_block"), F.lit(False).alias("_home"))))
    placed = pos.withColumn("_copy", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull()))).select(
        "*", "_copy._block", "_copy._home"
    ).drop("_copy")
    w = Window.partitionBy(*keys, "_block").orderBy("_pos")
    out = placed.withColumns({name: _shift_expr(w, src, off) for name, (src, off) in shifts.items()})
    return out.where(F.col("_home")).drop("_block", "_home", "_pos")
