"""Moving estimates over the last observations of each key; missing ones count as zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Fixed value: observations in the ring.
SIZE = 7


def _frame(key: Sequence[str], order: Sequence[str], low: int, high: int):
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(low, high)


def _trimmed(value: str, frame, size: int, whole: bool) -> Column:
    v, short = F.col(value), F.count(value).over(frame) < size
    low, high = F.min(v).over(frame), F.max(v).over(frame)
    zero = F.lit(0).cast("long") if whole else F.lit(0.0)
    low = F.when(short, F.least(zero, F.coalesce(low, zero))).otherwise(low)
    high = F.when(short, F.greatest(zero, F.coalesce(high, zero))).otherwise(high)
    total = F.coalesce(F.sum(v).over(frame), zero) - low - high
    if not whole:
        return total / (size - 2)
    # Integer quotients of longs stay exact: the remainder goes before the division.
    return ((total - total % (size - 2)) / (size - 2)).cast("long")


def trimmed_average(value: str, key: Sequence[str], order: Sequence[str], size: int = SIZE, whole: bool = False) -> Column:
    """Mean of the last `size` observations without one smallest and one largest. `whole`: integers, truncated."""
    if size <= 2:
        raise ValueError("size must exceed 2")
    return _trimmed(value, _frame(key, order, 1 - size, 0), size, whole)


def trimmed_prediction(value: str, key: Sequence[str], order: Sequence[str], size: int = SIZE, whole: bool = False) -> Column:
    """The same over the observations before this one."""
    if size <= 2:
        raise ValueError("size must exceed 2")
    return _trimmed(value, _frame(key, order, -size, -1), size, whole)


def average(value: str, key: Sequence[str], order: Sequence[str], size: int = SIZE) -> Column:
    """Sum of the last `size` observations over `size`."""
    return F.sum(value).over(_frame(key, order, 1 - size, 0)) / size
