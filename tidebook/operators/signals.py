"""Directional signals: one value per bin, positive for bullish.

Each signal first reduces the lattice to a few numbers per bin (a JVM aggregation by bin), and then takes its
slopes, averages and scores along time in chunks with a halo. Bands, sides and weights are parameters over
``k``, the distance from the spot in ticks, so they fit lattices of any radius.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import kernels
from tidebook.functions import windows as W
from tidebook.functions.chunks import CHUNK, apply_chunks, over_chunks
from tidebook.functions.quantiles import percentiles
from tidebook.functions.scalar import unit_interval
from tidebook.operators.gold import balance
from tidebook.schemas import require

#: Bands of distances from the spot, from and to.
BANDS = [(1, 3), (4, 11), (12, 23)]


@dataclass(frozen=True)
class Signal:
    name: str
    columns: tuple[str, ...]
    thresholds: tuple[float, ...]
    compute: Callable[..., DataFrame]
    adaptive: str | None = None


REGISTRY: dict[str, Signal] = {}


def signal(name: str, columns: list[str], thresholds: list[float], adaptive: str | None = None):
    """Register a function ``(lattice, radius, **parameters) -> (bin_seq, signal)``; parameters it doesn't know are an error."""
    def register(f):
        REGISTRY[name] = Signal(name, tuple(columns), tuple(thresholds), f, adaptive)
        return f

    return register


def compute(name: str, lattice: DataFrame, radius: int, **parameters) -> DataFrame:
    found = REGISTRY[name]
    require(lattice, ["bin_seq", "k", *found.columns], name)
    return found.compute(lattice, radius, **parameters)


# ---- reductions over the cells of a bin


def side_mean(x: str | Column, lo: int, hi: int, sign: int) -> Column:
    """Mean over the cells at distances lo to hi on one side; null if there are none."""
    x = F.col(x) if isinstance(x, str) else x
    d = F.col("k") * sign
    return F.avg(F.when(d.between(lo, hi), x))


def asymmetry(x: str, lo: int, hi: int, pull: bool) -> Column:
    """Bid mean less ask mean; the other way round for pulls, so that positive is bullish."""
    bid, ask = side_mean(x, lo, hi, -1), side_mean(x, lo, hi, 1)
    return ask - bid if pull else bid - ask


def bands_within(radius: int, bands: list[tuple[int, int]] = BANDS) -> list[tuple[int, int]]:
    return [(lo, min(hi, radius)) for lo, hi in bands if lo <= radius]


def inverse_mean(x: str, most: int, sign: int) -> Column:
    """Mean weighted by 1/|k| over the cells of a side up to a distance."""
    d = F.col("k") * sign
    w = F.when(d.between(1, most), 1 / d)
    return F.sum(w * F.col(x)) / F.sum(w)


def inverse_sum(x: str, sign: int) -> Column:
    d = F.col("k") * sign
    return F.coalesce(F.sum(F.when(d >= 1, F.col(x) / d)), F.lit(0.0))


def entropy(code: str, cells: Column, n: int) -> Column:
    """Shannon entropy in bits of the codes 1, -1, 0 over some cells, of which there are `n`."""
    total = F.lit(0.0)
    for value in (1, -1, 0):
        p = F.count_if(cells & (F.col(code) == value)) / n
        total = total - F.when(p > 0, p * F.log2(p + 1e-12)).otherwise(0.0)
    return total


def along_time(per_bin: DataFrame, halo: int, f: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray], chunk: int = CHUNK) -> DataFrame:
    """``bin_seq, signal`` of a numpy function of the columns and bin numbers of a chunk."""
    names = [c for c in per_bin.columns if c != "bin_seq"]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"signal": f({c: pdf[c].to_numpy(dtype=np.float64) for c in names}, pdf["bin_seq"].to_numpy())})

    return apply_chunks(per_bin, [], "bin_seq", halo, kernel, "signal double", chunk=chunk).select("bin_seq", "signal")


# ---- statistical signals


def combined_asymmetry(radius: int) -> Column:
    """Asymmetries of additions and pulls over the bands, each weighted by one over the root of its width."""
    bands = bands_within(radius)
    weights = [1 / math.sqrt(hi - lo + 1) for lo, hi in bands]
    total = sum(w * (asymmetry("v_add", lo, hi, False) + asymmetry("v_pull", lo, hi, True)) for (lo, hi), w in zip(bands, weights, strict=True))
    return total / sum(weights)


def blended_slopes(x: np.ndarray, windows, weights, z_window: int, z_min: int, scale: float) -> np.ndarray:
    return sum(w * np.tanh(kernels.robust_z(kernels.slope(x, n), z_window, z_min) / scale) for n, w in zip(windows, weights, strict=True))


@signal("ads", ["v_add", "v_pull"], [0.02, 0.05, 0.08, 0.10, 0.15, 0.20])
def ads(lattice: DataFrame, radius: int, windows=(10, 25, 50), weights=(0.40, 0.35, 0.25), z_window: int = 200, z_min: int = 30, scale: float = 3.0, chunk: int = CHUNK) -> DataFrame:
    """Slopes of the combined asymmetry, scored robustly and blended."""
    per_bin = lattice.groupBy("bin_seq").agg(combined_asymmetry(radius).alias("x"))
    return along_time(per_bin, z_window + max(windows), lambda c, i: blended_slopes(c["x"], windows, weights, z_window, z_min, scale), chunk)


@signal("spg", ["pressure_variant", "vacuum_variant"], [0.001, 0.005, 0.01, 0.05, 0.1, 0.2], "spread")
def spg(lattice: DataFrame, radius: int, reach: int = 16, fast: int = 5, slow: int = 20, curve: int = 10, near: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Spatial gradients of pressure and vacuum, below less above, smoothed twice, and the curvature at the spot."""
    w = Window.partitionBy("bin_seq").orderBy("k")
    gradient = lambda x: F.when(F.col("k") == -radius, F.lead(x).over(w) - F.col(x)).when(F.col("k") == radius, F.col(x) - F.lag(x).over(w)).otherwise((F.lead(x).over(w) - F.lag(x).over(w)) / 2)
    bend = F.lead("pressure_variant").over(w) + F.lag("pressure_variant").over(w) - 2 * F.col("pressure_variant")
    cells = lattice.select("bin_seq", "k", gradient("pressure_variant").alias("gp"), gradient("vacuum_variant").alias("gv"), bend.alias("bend"))
    reach = min(reach, radius)
    net = -(side_mean("gp", 1, reach, -1) - side_mean("gp", 1, reach, 1)) + (side_mean("gv", 1, reach, 1) - side_mean("gv", 1, reach, -1))
    per_bin = cells.groupBy("bin_seq").agg(net.alias("net"), (-F.avg(F.when(F.abs("k") <= near, F.col("bend")))).alias("curve"))
    alpha = lambda n: 2 / (n + 1)

    def f(c, i):
        smooth = 0.6 * kernels.ema(c["net"], alpha(fast)) + 0.4 * kernels.ema(c["net"], alpha(slow))
        return 0.7 * smooth + 0.3 * kernels.ema(c["curve"], alpha(curve))

    return along_time(per_bin, kernels.ema_halo(alpha(max(fast, slow, curve))), f, chunk)


@signal("erd", ["flow_state_code", "flow_score"], [0.05, 0.10, 0.15, 0.20, 0.30, 0.40, 0.50, 0.75, 1.0, 1.5, 2.0])
def erd(lattice: DataFrame, radius: int, z_window: int = 100, z_min: int = 30, floor: float = 0.5, variant: str = "a", chunk: int = CHUNK) -> DataFrame:
    """Entropy spikes of the flow states, times the direction of the scores (a) or of the entropies (b)."""
    if variant not in ("a", "b"):
        raise ValueError(f"variant is {variant}, not a or b")
    k = F.col("k")
    per_bin = lattice.groupBy("bin_seq").agg(
        entropy("flow_state_code", F.lit(True), 2 * radius + 1).alias("h"),
        (side_mean("flow_score", 1, radius, -1) - side_mean("flow_score", 1, radius, 1)).alias("a"),
        (entropy("flow_state_code", k > 0, radius) - entropy("flow_state_code", k < 0, radius)).alias("b"),
    )
    return along_time(per_bin, z_window, lambda c, i: c[variant] * np.maximum(0.0, kernels.robust_z(c["h"], z_window, z_min) - floor), chunk)


def lead_ratio(inner: np.ndarray, outer: np.ndarray, lag: int, alpha: float, rows: np.ndarray) -> np.ndarray:
    """Smoothed product with the outer zone `lag` bins ago over the product with it now."""
    past = np.zeros_like(outer)
    past[lag:] = outer[:-lag] if lag else outer
    return kernels.ema(inner * past, alpha) / (kernels.ema(inner * outer, alpha) + 1e-12)


def zones(radius: int, outer: tuple[int, int]) -> dict[str, Column]:
    """Means of the near and the far zone on either side, for building (add and fill) and for pulls."""
    found = {}
    for name, x in (("add", F.col("v_add") + F.col("v_fill")), ("pull", F.col("v_pull"))):
        for side, sign in (("bid", -1), ("ask", 1)):
            found[f"{name}_in_{side}"] = side_mean(x, 1, min(3, radius), sign)
            found[f"{name}_out_{side}"] = side_mean(x, min(outer[0], radius), min(outer[1], radius), sign)
    return found


def front(c: dict[str, np.ndarray], lag: int, alpha: float, i: np.ndarray) -> np.ndarray:
    ratio = {(x, s): lead_ratio(c[f"{x}_in_{s}"], c[f"{x}_out_{s}"], lag, alpha, i) for x in ("add", "pull") for s in ("bid", "ask")}
    return 0.6 * (ratio["add", "bid"] - ratio["add", "ask"]) + 0.4 * (ratio["pull", "ask"] - ratio["pull", "bid"])


@signal("pfp", ["v_add", "v_pull", "v_fill"], [0.001, 0.005, 0.01, 0.05, 0.1, 0.2], "magnitude")
def pfp(lattice: DataFrame, radius: int, outer: tuple[int, int] = (5, 12), lag: int = 5, alpha: float = 0.1, chunk: int = CHUNK) -> DataFrame:
    """Whether activity near the spot leads activity farther out, bid against ask."""
    per_bin = lattice.groupBy("bin_seq").agg(*[x.alias(n) for n, x in zones(radius, outer).items()])
    return along_time(per_bin, kernels.ema_halo(alpha) + lag, lambda c, i: front(c, lag, alpha, i), chunk)


@signal("jad", ["j_add", "j_pull", "a_add", "a_pull"], [0.05, 0.10, 0.15, 0.20, 0.30])
def jad(lattice: DataFrame, radius: int, reach: int = 24, z_window: int = 300, z_min: int = 30, scale: float = 3.0, chunk: int = CHUNK) -> DataFrame:
    """Jerk and acceleration asymmetries; where they disagree in sign, jerk weighs more."""
    reach = min(reach, radius)
    both = lambda d: 0.5 * (inverse_mean(f"{d}_add", reach, -1) - inverse_mean(f"{d}_add", reach, 1)) + 0.5 * (inverse_mean(f"{d}_pull", reach, 1) - inverse_mean(f"{d}_pull", reach, -1))
    per_bin = lattice.groupBy("bin_seq").agg(both("j").alias("j"), both("a").alias("a"))
    raw = F.when(F.signum("j") == F.signum("a"), 0.4 * F.col("j") + 0.6 * F.col("a")).otherwise(0.8 * F.col("j") + 0.2 * F.col("a"))
    return along_time(per_bin.select("bin_seq", raw.alias("x")), z_window, lambda c, i: np.tanh(kernels.robust_z(c["x"], z_window, z_min) / scale), chunk)


@signal("iirc", ["v_add", "v_pull", "v_fill"], [0.001, 0.005, 0.01, 0.02, 0.05], "extended")
def iirc(lattice: DataFrame, radius: int, reach: int = 16, eps: float = 1.0, windows=(10, 30), weights=(0.6, 0.4), noise: float = 0.1, chunk: int = CHUNK) -> DataFrame:
    """Slope of the log imbalance between adding and removing, bid against ask; 0 where the imbalance is small."""
    side = lambda x, sign: F.coalesce(F.sum(F.when((F.col("k") * sign).between(1, reach), F.col(x))), F.lit(0.0))
    ratio = lambda sign: side("v_add", sign) / (side("v_pull", sign) + side("v_fill", sign) + eps)
    per_bin = lattice.groupBy("bin_seq").agg((F.ln(ratio(-1) + 1) - F.ln(ratio(1) + 1)).alias("x"))

    def build(df: DataFrame, axis) -> DataFrame:
        raw = sum(w * W.slope(axis, "x", n) for n, w in zip(windows, weights, strict=True))
        return df.withColumn("signal", F.when(F.abs("x") >= noise, F.coalesce(raw, F.lit(0.0))).otherwise(0.0))

    return over_chunks(per_bin, [], "bin_seq", max(windows), build, chunk=chunk).select("bin_seq", "signal")


@signal("msd", ["vacuum_variant", "pressure_variant"], [0.001, 0.005, 0.01, 0.05, 0.1, 0.2], "magnitude")
def msd(lattice: DataFrame, radius: int, variant: str = "weighted") -> DataFrame:
    """Vacuum above less vacuum below, weighted by 1/|k| or plain."""
    k, v = F.col("k"), F.col("vacuum_variant")
    plain = F.coalesce(F.sum(F.when(k > 0, v)), F.lit(0.0)) - F.coalesce(F.sum(F.when(k < 0, v)), F.lit(0.0))
    weighted = inverse_sum("vacuum_variant", 1) - inverse_sum("vacuum_variant", -1)
    return lattice.groupBy("bin_seq").agg((weighted if variant == "weighted" else plain).alias("signal"))


def intensities(radius: int, exclusion: int = 0, power: float = 0.0) -> dict[str, Column]:
    """Weighted shares of the five states over a bin; weights fall with distance and sum to 1."""
    weight = lambda k: 0.0 if abs(k) <= exclusion and exclusion > 0 else 1.0 / max(1, abs(k)) ** power
    total = sum(weight(k) for k in range(-radius, radius + 1))
    if total <= 0:
        raise ValueError("no cell has a weight")
    w = F.when((F.abs("k") <= exclusion) & F.lit(exclusion > 0), 0.0).otherwise(1.0 / F.pow(F.greatest(F.lit(1), F.abs("k")), F.lit(power))) / total
    return {name: F.sum(F.when(F.col("state5_code") == code, w).otherwise(0.0)) for name, code in (("bear_vacuum", -2), ("bear_pressure", -1), ("mixed", 0), ("bull_pressure", 1), ("bull_vacuum", 2))}


@signal("derivative", ["state5_code"], [0.03, 0.05, 0.08, 0.10, 0.15, 0.20])
def derivative(lattice: DataFrame, radius: int, exclusion: int = 0, power: float = 0.0, z_window: int = 300, z_min: int = 75, scale: float = 3.0, d_weights=(1.0, 0.0, 0.0), state_weights=(1.0, 1.0, 1.0, 1.0), mixed_weight: float = 0.0, seconds: float = 0.1, chunk: int = CHUNK) -> DataFrame:
    """Time derivatives of bullish less bearish intensity, damped by mixed states, scored and blended.

    Where the robust scores of a derivative are 0 throughout, its scores by mean and deviation of the whole
    series count instead.
    """
    if sum(abs(w) for w in d_weights) <= 0:
        raise ValueError("all derivative weights are 0")
    bp, bv, sp, sv = state_weights
    per_bin = lattice.groupBy("bin_seq").agg(*[x.alias(n) for n, x in intensities(radius, exclusion, power).items()])
    net = bp * F.col("bull_pressure") + bv * F.col("bull_vacuum") - sp * F.col("bear_pressure") - sv * F.col("bear_vacuum")
    damp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mixed_weight * F.col("mixed")))
    per_bin = per_bin.select("bin_seq", (net * damp).alias("base"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        d, out = pdf["base"].to_numpy(), {}
        for n in (1, 2, 3):
            d = kernels.time_derivative(d, seconds)
            out[f"d{n}"], out[f"z{n}"] = d, kernels.robust_z(d, z_window, z_min)
        return pd.DataFrame(out)

    names = [f"{x}{n}" for n in (1, 2, 3) for x in "dz"]
    df = apply_chunks(per_bin, [], "bin_seq", z_window + 3, kernel, ", ".join(f"{n} double" for n in names), chunk=chunk)
    whole = df.agg(*[F.max(F.abs(f"z{n}")).alias(f"most{n}") for n in (1, 2, 3)], *[F.avg(f"d{n}").alias(f"mean{n}") for n in (1, 2, 3)], *[F.stddev_pop(f"d{n}").alias(f"std{n}") for n in (1, 2, 3)])
    row = whole.first()  # nine numbers
    score, norm = F.lit(0.0), sum(abs(w) for w in d_weights)
    for n, w in zip((1, 2, 3), d_weights, strict=True):
        z = F.col(f"z{n}")
        if not row[f"most{n}"] and (row[f"std{n}"] or 0) > 1e-12:
            z = (F.col(f"d{n}") - row[f"mean{n}"]) / row[f"std{n}"]
        score = score + w * F.tanh(z / scale)
    return df.select("bin_seq", unit_interval(score / norm).alias("signal"))


@signal("ads_pfp_svac", ["v_add", "v_fill", "v_pull", "vacuum_variant"], [0.02, 0.05, 0.08, 0.10, 0.15, 0.20], "magnitude")
def ads_pfp_svac(lattice: DataFrame, radius: int, bin_ms: int = 100, slope_ms=(1000, 2500, 5000), z_ms: int = 20_000, z_ratio: float = 0.15, warmup_ms: int = 20_000, lag_ms: int = 500, alpha: float = 0.1, outer: tuple[int, int] = (5, 12), svac_alpha: float = 0.05, svac_floor: float = 1e-6, weights=(0.40, 0.30, 0.30), chunk: int = CHUNK) -> DataFrame:
    """Asymmetry slopes, pressure fronts and normalised vacuum asymmetry; parts still warming up have no weight."""
    bins = lambda ms, least: max(least, math.ceil(ms / bin_ms))
    windows, z_window, warm, lag = [bins(m, 2) for m in slope_ms], bins(z_ms, 2), bins(warmup_ms, 1), bins(lag_ms, 1)
    z_min = max(2, min(z_window, math.floor(z_window * z_ratio)))
    vacuum = inverse_sum("vacuum_variant", 1) - inverse_sum("vacuum_variant", -1)
    per_bin = lattice.groupBy("bin_seq").agg(combined_asymmetry(radius).alias("x"), vacuum.alias("vac"), *[x.alias(n) for n, x in zones(radius, outer).items()])

    def f(c, i):
        slopes = blended_slopes(c["x"], windows, (0.40, 0.35, 0.25), z_window, z_min, 3.0)
        vac = c["vac"] / np.maximum(kernels.ema(np.abs(c["vac"]), svac_alpha), svac_floor)
        on = [np.where(i >= warm - 1, weights[0], 0.0), np.where(i >= lag - 1, weights[1], 0.0), np.full(len(i), weights[2])]
        return sum(w * s for w, s in zip(on, (slopes, front(c, lag, alpha, i), vac), strict=True)) / sum(on)

    return along_time(per_bin, max(z_window + max(windows), kernels.ema_halo(svac_alpha), kernels.ema_halo(alpha) + lag), f, chunk)


# ---- thresholds


def adaptive_thresholds(signals: DataFrame, name: str, warmup: int = 300) -> DataFrame:
    """``thresholds``: the positive distinct percentiles of a signal behind its warm-up, in order; the defaults if none is."""
    found = REGISTRY[name]
    behind = signals.filter(F.col("bin_seq") >= warmup)

    def of(df: DataFrame, value, *shares: float) -> list:
        return percentiles(df, value, shares).get(None, [None] * len(shares))

    if found.adaptive == "spread":
        p5, p25, p75, p95 = (F.lit(x).cast("double") for x in of(behind, F.col("signal"), 0.05, 0.25, 0.75, 0.95))
        a75, a95 = F.greatest(F.abs(p25), F.abs(p75)), F.greatest(F.abs(p5), F.abs(p95))
        values, least = F.array(0.5 * (p75 - p25), p75 - p25, a75, 0.5 * (a75 + a95), a95), 1e-8
    elif found.adaptive == "magnitude":
        values, least = F.array(*[F.lit(x).cast("double") for x in of(behind, F.abs("signal"), 0.5, 0.7, 0.8, 0.9, 0.95, 0.99)]), 0.0
    else:
        p95 = of(signals, F.abs(F.when(F.col("signal") != 0, F.col("signal"))), 0.95)[0] or 0.0
        more = [0.08, 0.10, *([0.20, 0.50] if p95 > 0.5 else [])] if found.adaptive == "extended" and p95 > 0.1 else []
        values, least = F.array(*[F.lit(x) for x in (*found.thresholds, *more)]), 0.0
    df = signals.sparkSession.range(1)
    kept = F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda x: F.round(x, 6)), lambda x: x > least)))
    return df.select(F.when(F.size(kept) > 0, kept).otherwise(F.array(*[F.lit(x) for x in found.thresholds])).alias("thresholds"))


def directional_edge(lattice: DataFrame, radius: int, bands=(4, 8, 16), windows=(25, 50, 100, 200), chunk: int = CHUNK) -> DataFrame:
    """Composites of the nearest cells, below less above, over nested bands weighted by one over the root of their
    width, then trailing means over time windows weighted alike."""
    weights = [1 / math.sqrt(b) for b in bands]
    cells = lattice.withColumn("_c", balance(F.col("pressure_variant"), F.col("vacuum_variant")))
    edge = sum(w * asymmetry("_c", 1, b, False) for b, w in zip(bands, weights, strict=True)) / sum(weights)
    time = [1 / math.sqrt(n) for n in windows]

    def build(df: DataFrame, axis) -> DataFrame:
        return df.withColumn("signal", W.rollup(axis, "edge", list(windows), [w / sum(time) for w in time]))

    return over_chunks(cells.groupBy("bin_seq").agg(edge.alias("edge")), [], "bin_seq", max(windows), build, chunk=chunk).select("bin_seq", "signal")


#: Edges from which a position holds or tightens, and how far a vacuum must exceed its pressure.
HOLD_EDGE, TIGHTEN_EDGE, THIN_RATIO = 5, 2, 1.15


def force_labels(forces: DataFrame) -> DataFrame:
    """``bin_seq, long_action, short_action, risk`` from the pressure and vacuum totals above and below the spot.

    Pressure below and vacuum above push up. A side holds if the edge is its way by `HOLD_EDGE` and both of its
    forces lead, tightens until the edge is against it by `TIGHTEN_EDGE`, and leaves then.
    """
    k, total = F.col("k"), lambda x, side: F.sum(F.when(side, F.col(x)).otherwise(0.0))
    above = {n: total(f"{n}_variant", k > 0).alias(f"{n}_above") for n in ("pressure", "vacuum")}
    below = {n: total(f"{n}_variant", k < 0).alias(f"{n}_below") for n in ("pressure", "vacuum")}
    df = forces.groupBy("bin_seq").agg(*above.values(), *below.values())
    pa, va, pb, vb = (F.col(c) for c in ("pressure_above", "vacuum_above", "pressure_below", "vacuum_below"))
    edge = (pb + va) - (pa + vb)
    action = lambda e, leads: F.when((e > HOLD_EDGE) & leads, "HOLD").when(e > -TIGHTEN_EDGE, "TIGHTEN").otherwise("EXIT")
    thin = lambda v, p: v > F.greatest(p * THIN_RATIO, F.lit(2.0))
    risk = F.when(thin(vb, pb), "SUPPORT FAILING").when(thin(va, pa), "RESISTANCE THINNING").when(edge >= TIGHTEN_EDGE, "UP ADVANTAGE").when(edge <= -TIGHTEN_EDGE, "DOWN ADVANTAGE").otherwise("BALANCED")
    return df.select("bin_seq", action(edge, (va > pa) & (pb > vb)).alias("long_action"), action(-edge, (pa > va) & (vb > pb)).alias("short_action"), risk.alias("risk"))
