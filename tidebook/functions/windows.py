"""Sequence functions as Columns over an `Axis`. Edge rules are part of each function's meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.functions.chunks import Axis

TINY = 1e-12


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def have(axis: Axis, window: int) -> Column:
    """Rows that a trailing window holds at this row."""
    return F.least(axis.number + 1, F.lit(window))


def trailing_mean(axis: Axis, x: str | Column, window: int) -> Column:
    """Mean of the last `window` rows; the head has what is there."""
    return F.avg(c(x)).over(axis.last(window))


def rollup(axis: Axis, x: str | Column, windows: list[int], weights: list[float]) -> Column:
    """Weighted sum of trailing means; weights are taken as they are."""
    return sum(F.lit(float(w)) * trailing_mean(axis, x, n) for n, w in zip(windows, weights, strict=True))


def trailing(axis: Axis, x: str | Column, window: int, how: str) -> Column:
    """mean, std (sample, null for one row), min, max or sum of the last `window` rows."""
    f = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}[how]
    return f(c(x)).over(axis.last(window))


def padded_mean(axis: Axis, x: str | Column, window: int) -> Column:
    """Sum of the last rows over `window`, so a short head counts as zeros."""
    return F.sum(c(x)).over(axis.last(window)) / window


def full_mean(axis: Axis, x: str | Column, window: int) -> Column:
    """Trailing mean, 0 until the window is full."""
    return F.when(axis.number >= window - 1, F.avg(c(x)).over(axis.last(window))).otherwise(0.0)


def full_std(axis: Axis, x: str | Column, window: int) -> Column:
    """Population deviation of the window, 0 until it is full."""
    return F.when(axis.number >= window - 1, F.stddev_pop(c(x)).over(axis.last(window))).otherwise(0.0)


def full_skew(axis: Axis, x: str | Column, window: int) -> Column:
    """Population skew of the window; 0 until it is full and where the variance is at most 1e-12."""
    w, x = axis.last(window), c(x)
    mean, var = F.avg(x).over(w), F.var_pop(x).over(w)
    third = F.avg(x * x * x).over(w) - 3 * mean * F.avg(x * x).over(w) + 2 * mean * mean * mean
    return F.when((axis.number >= window - 1) & (var > TINY), third / F.pow(var, 1.5)).otherwise(0.0)


def slope(axis: Axis, x: str | Column, window: int) -> Column:
    """Least-squares slope against 0, 1, ..., window - 1; null until the window is full.

    Only sums are needed: with the row number i, the centred places are ``i - mean(i)``, which slide along.
    """
    w, i = axis.last(window), axis.number
    spread = window * (window * window - 1) / 12
    total = F.sum(c(x) * i).over(w) - (i - (window - 1) / 2) * F.sum(c(x)).over(w)
    return F.when(i >= window - 1, total / spread)


def z_score(axis: Axis, x: str | Column, window: int) -> Column:
    """(x - mean) / (sample deviation + 1e-12); null in the first row."""
    return (c(x) - F.avg(c(x)).over(axis.last(window))) / (F.stddev_samp(c(x)).over(axis.last(window)) + TINY)


def lagged(axis: Axis, x: str | Column, n: int) -> Column:
    return F.coalesce(F.lag(c(x), n).over(axis.ordered), F.lit(0.0))


def derivative(axis: Axis, x: str | Column, seconds: float, zeros: int = 1) -> Column:
    """Difference to the row before per second; 0 in the first `zeros` rows."""
    return F.when(axis.number >= zeros, (c(x) - F.lag(c(x)).over(axis.ordered)) / seconds).otherwise(0.0)


def derivatives(axis: Axis, x: str | Column, seconds: float, strict: bool = True) -> list[Column]:
    """First to third time derivative. Strict: the nth is 0 in the first n rows; else in the first row alone.

    Written out over lags, so that one window computes all three.
    """
    at = lambda n: F.lag(c(x), n).over(axis.ordered)
    x, i = c(x), axis.number
    zero = F.lit(0.0)
    d1 = lambda a, b, row: F.when(row >= 1, (a - b) / seconds).otherwise(zero)
    d1_0, d1_1, d1_2 = d1(x, at(1), i), d1(at(1), at(2), i - 1), d1(at(2), at(3), i - 2)
    need2, need3 = (2, 3) if strict else (1, 1)
    d2_0 = F.when(i >= need2, (d1_0 - d1_1) / seconds).otherwise(zero)
    d2_1 = F.when(i - 1 >= need2, (d1_1 - d1_2) / seconds).otherwise(zero)
    d3_0 = F.when(i >= need3, (d2_0 - d2_1) / seconds).otherwise(zero)
    return [d1_0, d2_0, d3_0]


def move(axis: Axis, x: str | Column) -> Column:
    """Ticks from the row before; 0 where either side is missing or not positive."""
    now, then = c(x), F.lag(c(x)).over(axis.ordered)
    return F.when((now > 0) & (then > 0), now - then).otherwise(0)


def microstate(ask_sign: Column, bid_sign: Column) -> Column:
    """The nine pairs of signs as 0 to 8; 4 is an unmoved book."""
    return ((ask_sign + 1) * 3 + bid_sign + 1).cast("tinyint")
