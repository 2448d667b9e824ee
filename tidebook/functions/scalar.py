"""Scalar expressions: sanitising, rounding, time, text and hashes."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and null become 0."""
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def unit_interval(x: Column) -> Column:
    """NaN becomes 0, infinities and what is beyond become -1 or 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), finite(x)))


def json_safe(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded for output, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def tick(price: Column, tick_size: float, anchor: Column | int, n_ticks: int) -> Column:
    """Place of a price in a grid of `n_ticks` around the anchor tick, halves up; null outside."""
    at = F.floor(price / tick_size + 0.5) - anchor + n_ticks // 2
    return F.when((at >= 0) & (at < n_ticks), at)


def dollars(price_int: Column) -> Column:
    return price_int * 1e-9


def decay_alpha(seconds: Column, tau: float) -> Column:
    """``1 - exp(-dt / tau)``: 0 for no time, 1 beyond 50 time constants."""
    return F.when(seconds <= 0, 0.0).when(seconds / tau > 50, 1.0).otherwise(1 - F.exp(-seconds / tau))


def div_eps(a: Column, b: Column) -> Column:
    return a / (b + 1e-12)


def projection(s: Column, d1: Column, d2: Column, d3: Column, h: float, cubic: float = 0.0, damp: float = 0.0) -> Column:
    """Score `h` seconds ahead by its derivatives, damped, within [-1, 1]."""
    raw = s + d1 * h + 0.5 * d2 * h * h + cubic * d3 * h**3 / 6
    return unit_interval(raw * math.exp(-damp * h))


def piecewise(x: Column, anchors: list[tuple[float, float]]) -> Column:
    """Linear between the anchors, constant beyond them."""
    out = F.when(x <= anchors[0][0], F.lit(float(anchors[0][1])))
    for (x0, y0), (x1, y1) in zip(anchors, anchors[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(anchors[-1][1])))


def wall_clock_ns(day: Column, clock: Column, zone: str = "America/New_York", warmup_minutes: int = 0) -> Column:
    """UTC nanoseconds of a wall-clock time of a zone, with its daylight-saving rules, less a warm-up."""
    utc = F.to_utc_timestamp(F.concat_ws(" ", day.cast("string"), clock).cast("timestamp"), zone)
    return (F.unix_micros(utc) - F.lit(warmup_minutes) * 60_000_000) * 1000


def iso(ns: Column) -> Column:
    """ISO 8601 with microseconds."""
    return F.date_format(F.timestamp_micros(F.floor(ns / 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def is_third_friday(day: Column) -> Column:
    return (F.dayofweek(day) == 6) & F.dayofmonth(day).between(15, 21)


def is_last_business_day(day: Column) -> Column:
    last = F.last_day(day)
    back = F.when(F.dayofweek(last) == 7, 1).when(F.dayofweek(last) == 1, 2).otherwise(0)
    return day == F.date_sub(last, back)


def is_quarterly(day: Column) -> Column:
    """The third Friday of the last month of a quarter."""
    return is_third_friday(day) & (F.month(day) % 3 == 0)


def slug(text: Column) -> Column:
    """Lower case, each run of other characters than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def config_hash(config: dict, length: int = 12) -> str:
    """Of sorted ``key=value`` pairs joined by a pipe."""
    return hashlib.sha256("|".join(f"{k}={config[k]}" for k in sorted(config)).encode()).hexdigest()[:length]


def json_hash(value: object, length: int = 64) -> str:
    """Of canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:length]
