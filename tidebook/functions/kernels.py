"""Numpy kernels for what Spark's window functions can't express: recursions and robust statistics.

Each gets a bounded stretch of a series (a chunk and its halo) with the number of its first row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

#: The median absolute deviation of a normal law times this is its standard deviation.
MAD_SIGMA = 1.4826
CELLS = 4_000_000


def ema(x: np.ndarray, alpha: float) -> np.ndarray:
    """``e = alpha * x + (1 - alpha) * e``, seeded with the first value."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy() if len(x) else np.zeros(0)


def ema_halo(alpha: float) -> int:
    """Rows after which a seed weighs less than a double can tell."""
    return math.ceil(math.log(1e-18) / math.log(1 - alpha))


def robust_z(x: np.ndarray, window: int, min_periods: int, eps: float = 1e-12) -> np.ndarray:
    """(x - median) / (1.4826 MAD) over the last `window` rows, itself included; 0 where the scale is at most
    `eps`, where fewer than `min_periods` rows are there, and where the window holds a NaN."""
    out = np.zeros(len(x))
    if not len(x):
        return out
    ahead = np.full(window - 1, np.nan)
    padded = np.concatenate([ahead, x])
    windows = np.lib.stride_tricks.sliding_window_view(padded, window)
    step = max(1, CELLS // window)
    for at in range(0, len(x), step):
        part = windows[at : at + step]
        rows = np.arange(at, at + len(part))
        have = np.minimum(rows + 1, window)
        short = have < window
        med, mad = np.full(len(part), np.nan), np.full(len(part), np.nan)
        if (~short).any():
            full = part[~short]
            med[~short] = np.median(full, axis=1)
            mad[~short] = np.median(np.abs(full - med[~short, None]), axis=1)
        for i in np.flatnonzero(short & (have >= min_periods)):
            own = x[: rows[i] + 1]
            med[i] = np.median(own)
            mad[i] = np.median(np.abs(own - med[i]))
        scale = MAD_SIGMA * mad
        ok = scale > eps
        out[rows[ok]] = (x[rows[ok]] - med[ok]) / scale[ok]
    return out


def slope(x: np.ndarray, window: int, first: int = 0) -> np.ndarray:
    """Least-squares slope over the last `window` rows against 0, 1, ...; NaN while the series is shorter."""
    out = np.full(len(x), np.nan)
    if len(x) >= window:
        at = np.arange(window) - (window - 1) / 2
        windows = np.lib.stride_tricks.sliding_window_view(x, window)
        out[window - 1 :] = windows @ at / (at @ at)
    return out


def trailing_mean(x: np.ndarray, window: int) -> np.ndarray:
    return pd.Series(x).rolling(window, min_periods=1).mean().to_numpy()


def time_derivative(x: np.ndarray, seconds: float) -> np.ndarray:
    """Difference to the row before per second, 0 for the first."""
    return np.diff(x, prepend=x[:1]) / seconds


def decayed_max(x: np.ndarray, decay: float) -> np.ndarray:
    """``m = max(decay * m, |x|)``: the largest decayed magnitude so far.

    |x| / decay**i turns it into a running maximum; in logarithms, so that nothing overflows.
    """
    with np.errstate(divide="ignore"):
        shifted = np.log(np.abs(x)) - np.arange(len(x)) * math.log(decay)
    return np.exp(np.maximum.accumulate(shifted) + np.arange(len(x)) * math.log(decay))


def tanh_blend(zs: list[np.ndarray], weights: list[float], scale: float) -> np.ndarray:
    """Weighted mean of tanh(z / scale), kept within [-1, 1] with NaN as 0."""
    norm = sum(abs(w) for w in weights)
    total = sum(w * np.tanh(z / scale) for z, w in zip(zs, weights, strict=True))
    return np.clip(np.nan_to_num(total / norm if norm else total, nan=0.0), -1.0, 1.0)
