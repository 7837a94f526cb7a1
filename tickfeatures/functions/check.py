"""Stable rounding of floating results, for comparing two engines.

Means of short decimals often land exactly on a rounding tie, and two correct
summation orders then round differently. Shifting by a tiny constant before
rounding moves the ties off the representable grid; the oracle SQL applies the
same expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the comparison projection (also used in the oracle SQL).
ROUND_SHIFT = 1.2345e-9
ROUND_DIGITS = 6


def stable_round(df: DataFrame, digits: int = ROUND_DIGITS) -> DataFrame:
    """Round every float/double column as ``round(x + shift, digits) + 0.0``; other columns pass through.

    "+ 0.0" turns a rounded -0.0 into 0.0. Built as one ``selectExpr`` (one
    call into the JVM instead of several per column).
    """
    exprs = []
    for f in df.schema.fields:
        name = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(f"{sql_round(name, digits)} AS {name}")
        else:
            exprs.append(name)
    return df.selectExpr(*exprs)


def sql_round(expr: str, digits: int = ROUND_DIGITS) -> str:
    """The same rounding as SQL text."""
    return f"(round(({expr}) + {ROUND_SHIFT}, {digits}) + 0.0)"
