"""Numeric and calendar column functions with one NULL policy: what is not a finite number is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def clip(c: Column, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL (greatest and least would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def sig_round(c: Column, digits: int) -> Column:
    """Round to significant figures."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.try_divide(F.round(c * scale), F.nullif(scale, F.lit(0.0))))


def add_business_days(d: Column, n: int) -> Column:
    """The date n weekdays later; from a weekend the first one is Monday."""
    weekday = F.weekday(d)
    start = F.when(weekday >= 5, 4).otherwise(weekday)  # count from the Friday before
    base = F.date_sub(d, F.when(weekday >= 5, weekday - 4).otherwise(0))
    return F.date_add(base, (F.lit(n) + F.floor((start + n) / 5) * 2).cast("int"))


def banker_round(c: Column) -> Column:
    return F.bround(c, 0)


def half_up(c: Column, digits: int) -> Column:
    """Rounded by the binary value, halves up, as money reports do."""
    return F.floor(c * 10**digits + 0.5) / 10**digits
