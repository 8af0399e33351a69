"""Trailing windows over long (symbol, date) tables.

All functions partition by symbol and order by date, so Spark plans one exchange and one sort for
everything selected together.  A rolling value is NULL until ``min_periods`` values are in its window.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.num import finite, safe_div

def by():
    return Window.partitionBy("symbol").orderBy("date")


def trailing(n: int):
    return by().rowsBetween(-(n - 1), 0)


def rolling(agg, c: Column, n: int, min_periods: int | None = None) -> Column:
    w = trailing(n)
    return F.when(F.count(c).over(w) >= (n if min_periods is None else min_periods), agg(c).over(w))


def rmean(c: Column, n: int, min_periods: int | None = None) -> Column:
    return rolling(F.avg, c, n, min_periods)


def rstd(c: Column, n: int, min_periods: int | None = None) -> Column:
    return rolling(F.stddev_samp, c, n, max(2, min_periods or n))


def rsum(c: Column, n: int, min_periods: int | None = None) -> Column:
    return rolling(F.sum, c, n, min_periods)


def lag(c: Column, n: int = 1) -> Column:
    return F.lag(c, n).over(by())


def log_return(c: Column, n: int = 1) -> Column:
    return finite(F.log(safe_div(c, lag(c, n))))


def change(c: Column, n: int = 1) -> Column:
    return safe_div(c, lag(c, n)) - 1


def zscore(c: Column, n: int, min_periods: int) -> Column:
    return safe_div(c - rmean(c, n, min_periods), rstd(c, n, min_periods))


def ffill(c: Column, window=None) -> Column:
    return F.last(c, ignorenulls=True).over((window or by()).rowsBetween(Window.unboundedPreceding, 0))


def bfill(c: Column) -> Column:
    """The next value at or after; read from the last row back, so a symbol's rows take one pass."""
    return F.last(c, ignorenulls=True).over(Window.partitionBy("symbol").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0))
