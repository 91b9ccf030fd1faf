"""Rounding and averages that give the same digits whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metrics carry at most three decimals, so a thousandth is their exact integer unit.
MILLI = 1e3


def half_up(x: Column, places: int = 3) -> Column:
    """Round half up; unlike ``round`` it works on the binary value, not on its printed form."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def to_milli(x: Column) -> Column:
    """The value in thousandths, as a bigint."""
    return F.floor(x * MILLI + 0.5)


def sum_milli(x: Column) -> Column:
    """Sum in thousandths: integers, so the order of the addends cannot show."""
    return F.sum(to_milli(x))


def average_of(milli: Column, count: Column) -> Column:
    """Rounded average from a sum in thousandths; 0 when there were no values."""
    mean = milli.cast("double") / F.nullif(count, F.lit(0))
    return F.coalesce(F.floor(mean + 0.5) / MILLI, F.lit(0.0))


def clamp(x: Column, low: float | None, high: float | None) -> Column:
    """Force into [low, high]; a null stays null."""
    bounded = x
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    return F.when(x.isNotNull(), bounded)


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    return half_up(part * 100.0 / whole, places)
