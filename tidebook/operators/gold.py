"""Gold features of a silver lattice: forces, rollup, derivatives, scores and states, in one pass of windows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions import kernels
from tidebook.functions import windows as W
from tidebook.functions.chunks import CHUNK, apply_chunks, over_chunks
from tidebook.schemas import require


@dataclass(frozen=True)
class GoldConfig:
    """Coefficients c1 to c7, rollup and scoring. Defaults are fixed values of the model."""

    c: tuple[float, ...] = (1.0, 0.5, 0.3, 1.0, 1.5, 0.5, 0.3)
    windows: tuple[int, ...] = (5, 10, 20, 40)
    weights: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0)
    derivative_weights: tuple[float, ...] = (0.55, 0.30, 0.15)
    tanh_scale: float = 3.0
    neutral: float = 0.15
    z_window: int = 300
    z_min: int = 75
    seconds: float = 0.1
    chunk: int = field(default=CHUNK)


DEFAULT = GoldConfig()


def forces(cfg: GoldConfig = DEFAULT) -> dict[str, Column]:
    """Pressure and vacuum of a cell."""
    plus = lambda x: F.greatest(x, F.lit(0.0))
    c1, c2, c3, c4, c5, c6, c7 = (F.lit(x) for x in cfg.c)
    rest = F.col("v_rest_depth")
    return {
        "pressure_variant": c1 * F.col("v_add") + c2 * plus(rest) + c3 * plus(F.col("a_add")),
        "vacuum_variant": c4 * F.col("v_pull") + c5 * F.col("v_fill") + c6 * plus(-rest) + c7 * plus(F.col("a_pull")),
    }


def balance(p: Column, v: Column) -> Column:
    return (p - v) / (F.abs(p) + F.abs(v) + 1e-12)


def state5(k: Column, ask: Column, bid: Column) -> Column:
    """2 bullish vacuum, 1 bullish pressure, 0 mixed, -1 bearish pressure, -2 bearish vacuum, by the moves of best prices.

    Bullish is a bid that rises while the ask doesn't fall: vacuum above the spot, pressure below it. A bid that
    rises into a falling ask is mixed, as are no moves and the spot; all else is bearish, pressure above and
    vacuum below.
    """
    still, torn = (ask == 0) & (bid == 0), (ask < 0) & (bid > 0)
    bull = (bid > 0) & (ask >= 0)
    return F.when((k == 0) | still | torn, 0).when(k > 0, F.when(bull, 2).otherwise(-1)).otherwise(F.when(bull, 1).otherwise(-2)).cast("tinyint")


def force_block(silver: DataFrame, cfg: GoldConfig = DEFAULT) -> DataFrame:
    """The lattice with forces, composite and its three derivatives."""
    require(silver, ["bin_seq", "k", "v_add", "v_pull", "v_fill", "v_rest_depth", "a_add", "a_pull"], "silver")
    df = silver.withColumns(forces(cfg))
    df = df.withColumn("_raw", balance(F.col("pressure_variant"), F.col("vacuum_variant")))

    def build(part: DataFrame, axis) -> DataFrame:
        part = part.withColumn("composite", W.rollup(axis, "_raw", list(cfg.windows), list(cfg.weights)))
        return part.withColumns(dict(zip(("composite_d1", "composite_d2", "composite_d3"), W.derivatives(axis, "composite", cfg.seconds), strict=True)))

    return over_chunks(df, ["k"], "bin_seq", max(cfg.windows) + 3, build, chunk=cfg.chunk).drop("_raw")


def score_kernel(cfg: GoldConfig = DEFAULT):
    """The kernel of `scored`: rows of one level in order in, flow_score and flow_state_code out."""
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        zs = [kernels.robust_z(pdf[f"composite_d{i}"].to_numpy(), cfg.z_window, cfg.z_min, 1e-9) for i in (1, 2, 3)]
        score = kernels.tanh_blend(zs, list(cfg.derivative_weights), cfg.tanh_scale)
        return pd.DataFrame({"flow_score": score, "flow_state_code": ((score >= cfg.neutral).astype(np.int8) - (score <= -cfg.neutral).astype(np.int8))})

    return kernel


def scored(df: DataFrame, cfg: GoldConfig = DEFAULT) -> DataFrame:
    """flow_score and flow_state_code from the derivatives: robust z, weights normed to 1, tanh."""
    return apply_chunks(df, ["k"], "bin_seq", cfg.z_window, score_kernel(cfg), "flow_score double, flow_state_code tinyint", chunk=cfg.chunk)


def gold(silver: DataFrame, cfg: GoldConfig = DEFAULT) -> DataFrame:
    """``bin_seq, k`` and all gold columns."""
    df = force_block(silver, cfg).withColumn("state5_code", state5(F.col("k"), F.col("ask_reprice_sign"), F.col("bid_reprice_sign")))
    keep = ["bin_seq", "k", "pressure_variant", "vacuum_variant", "composite", "composite_d1", "composite_d2", "composite_d3", "state5_code"]
    return scored(df.select(*keep), cfg)


def check_dense(df: DataFrame, n_cells: int) -> None:
    """Every bin has exactly `n_cells` rows, or it's an error."""
    bad = df.groupBy("bin_seq").count().filter(F.col("count") != n_cells).limit(1).collect()
    if bad:
        raise ValueError(f"bin {bad[0][0]} has {bad[0][1]} cells instead of {n_cells}")
