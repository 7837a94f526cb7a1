"""Direction labels and volatility flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DIRECTION_DOWN, DIRECTION_NONE, DIRECTION_SAME, DIRECTION_UP


def direction_flags(change: str | Column, eps: float) -> dict[str, Column]:
    """Boolean up / down / same flags of a price change with threshold ``eps``.

    Up is ``change >= eps``, down is ``change <= -eps``, same is strictly
    between; exactly one holds for a finite change.
    """
    c = F.col(change) if isinstance(change, str) else change
    return {
        "inc_t": c >= F.lit(eps),
        "dec_t": c <= F.lit(-eps),
        "same_t": (c > F.lit(-eps)) & (c < F.lit(eps)),
    }


def direction_class(up: str | Column, same: str | Column, down: str | Column) -> Column:
    """Multi-class label from 0/1 flags: up 2, else same 1, else down 0, else 3."""
    u, s, d = (F.col(x) if isinstance(x, str) else x for x in (up, same, down))
    return (
        F.when(u > 0, DIRECTION_UP)
        .when(s > 0, DIRECTION_SAME)
        .when(d > 0, DIRECTION_DOWN)
        .otherwise(DIRECTION_NONE)
    )


def current_direction(change: str | Column, eps: float) -> Column:
    """Direction class of the change itself (the persistence forecast)."""
    c = F.col(change) if isinstance(change, str) else change
    return (
        F.when(c >= F.lit(eps), DIRECTION_UP)
        .when(c <= F.lit(-eps), DIRECTION_DOWN)
        .when(c.isNotNull(), DIRECTION_SAME)
    )


def volatility_flag(change: str | Column, std: str | Column, k: float = 2.0) -> Column:
    """One-sided: 1 when the change rises above ``k`` standard deviations."""
    c = F.col(change) if isinstance(change, str) else change
    s = F.col(std) if isinstance(std, str) else std
    return (c > s * F.lit(k)).cast("int")
