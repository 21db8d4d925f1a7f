"""Window expressions over ordered series; partial frames give null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12


def series(by: str = "symbol", order: str = "ts") -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def lagged(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    return F.lag(x, n).over(w or series())


def rolling(fn: Callable[[Column], Column], x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """fn over the last n rows, null until n values are there."""
    frame = (w or series()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, fn(x).over(frame))


def log_return(x: Column) -> Column:
    return F.ln(x) - lagged(F.ln(x), 1)


def momentum(x: Column, n: int) -> Column:
    return x / lagged(x, n) - 1


def zscore(x: Column, n: int) -> Column:
    return (x - rolling(F.avg, x, n)) / (rolling(F.stddev_samp, x, n) + EPS)


def band_position(x: Column, n: int) -> Column:
    """Place inside a band of two deviations around the mean."""
    return (x - rolling(F.avg, x, n)) / (2 * rolling(F.stddev_samp, x, n) + EPS)


def ratio_to_mean(x: Column, n: int) -> Column:
    return x / (rolling(F.avg, x, n) + EPS)


def forward_fill(x: Column, w: WindowSpec | None = None) -> Column:
    return F.last(x, ignorenulls=True).over((w or series()).rowsBetween(Window.unboundedPreceding, 0))


def finite(x: Column) -> Column:
    """Infinite and NaN values become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(x, digits) + F.lit(0.0)
