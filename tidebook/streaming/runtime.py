"""The derivative signal bin by bin, as a live runtime has it: levels gather until their bin is whole, whole bins are scored.

State per series has two stages. The first holds the states of the levels of bins that aren't whole yet; when the next bin in
order has all its levels, they are reduced to intensities. The second holds the last bins' values, which is all that the
derivatives and the robust scores of a new bin look back on. So a stream gives the numbers of a run over the whole series,
wherever triggers cut it, in whatever order the rows of a batch come and however often some are sent again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebook.functions import kernels
from tidebook.functions.scalar import unit_interval

#: Codes of the states from bearish to bullish, of a level without a state, and of one that hasn't come.
STATES, NONE, MISSING = (-2, -1, 0, 1, 2), 100, 101


def level_weights(radius: int, exclusion: int, power: float) -> np.ndarray:
    """Weights of the levels -radius to radius, falling with distance; they sum to 1."""
    k = np.abs(np.arange(-radius, radius + 1))
    w = np.where((k <= exclusion) & (exclusion > 0), 0.0, 1.0 / np.maximum(1, k) ** float(power))
    if w.sum() <= 0:
        raise ValueError("no cell has a weight")
    return w / w.sum()


def derivatives(
    stream: DataFrame, radius: int, first_bin: int = 0, exclusion: int = 0, power: float = 0.0, z_window: int = 300, z_min: int = 75, scale: float = 3.0,
    d_weights=(1.0, 0.0, 0.0), state_weights=(1.0, 1.0, 1.0, 1.0), mixed_weight: float = 0.0, seconds: float = 0.1,
) -> DataFrame:
    """``series, bin_seq, signal, ready, base, d1, d2, d3, z1, z2, z3, state5_code`` of every bin that is whole, from `first_bin` on.

    Rows are ``series, bin_seq, k, state5_code``. A bin waits for all its 2 * radius + 1 levels and for the bins before it.
    Levels beyond the radius and rows of bins already scored are left out; of a level sent twice the last row in order of the
    batch counts. A null code is a level without a state. ``ready`` says that the scores have enough bins; the dominant
    state is the first of those with the largest intensity. Scores z1 to z3 are the robust ones alone, by their window; what
    takes a whole series is in `finished`.
    """
    weights, levels, halo, norm = level_weights(radius, exclusion, power), 2 * radius + 1, z_window + 3, sum(abs(w) for w in d_weights)
    if norm <= 0:
        raise ValueError("all derivative weights are 0")
    bp, bv, sp, sv = state_weights

    def scores(codes: np.ndarray, tail: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Columns of some new bins, and the values of all bins that are known now."""
        parts = np.stack([(codes == c) @ weights for c in STATES])
        bear_v, bear_p, mixed, bull_p, bull_v = parts
        base = (bp * bull_p + bv * bull_v - sp * bear_p - sv * bear_v) * np.clip(1 - mixed_weight * mixed, 0.0, 1.0)
        known = np.concatenate([tail, base])
        d, score, out = known, np.zeros(len(known)), {}
        for n, w in zip((1, 2, 3), d_weights, strict=True):
            d = kernels.time_derivative(d, seconds)
            out[f"d{n}"] = d[len(tail) :]
            z = kernels.robust_z(d, z_window, z_min)
            out[f"z{n}"] = z[len(tail) :]
            score += w * np.tanh(z / scale)
        signal = np.clip(np.nan_to_num(score / norm, nan=0.0, posinf=0.0, neginf=0.0), -1.0, 1.0)[len(tail) :]
        return {"signal": signal, "base": base, **out, "state5_code": np.array(STATES)[parts.argmax(axis=0)]}, known

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, bins, flat, tail = state.get if state.exists else (first_bin, [], [], [])
        opened = dict(zip(bins, np.array(flat, np.int8).reshape(len(bins), levels), strict=True))
        for rows in batches:
            rows = rows[(rows["bin_seq"] >= at) & rows["k"].between(-radius, radius)]
            codes = rows["state5_code"].fillna(NONE).to_numpy(np.int8)
            for b, places in rows.reset_index(drop=True).groupby("bin_seq").indices.items():
                own = opened.setdefault(int(b), np.full(levels, MISSING, np.int8))
                own[rows["k"].to_numpy(np.int64)[places] + radius] = codes[places]
        whole = []
        while at in opened and (opened[at] != MISSING).all():
            whole.append(opened.pop(at))
            at += 1
        if whole:
            columns, known = scores(np.array(whole), np.array(tail, float))
            numbers = np.arange(at - len(whole), at)
            yield pd.DataFrame({"series": [key[0]] * len(whole), "bin_seq": numbers, "ready": numbers - first_bin + 1 >= z_min, **columns})
            tail = known[-halo:].tolist()
        state.update((at, list(opened), np.concatenate([np.empty(0, np.int64), *opened.values()]).astype(int).tolist(), [float(x) for x in tail]))

    kind = stream.schema["series"].dataType.simpleString()
    columns = f"series {kind}, bin_seq bigint, signal double, ready boolean, base double, d1 double, d2 double, d3 double, z1 double, z2 double, z3 double, state5_code int"
    rows = stream.select("series", "bin_seq", "k", "state5_code")
    return rows.groupBy("series").applyInPandasWithState(step, columns, "at bigint, bins array<bigint>, flat array<int>, tail array<double>", "append", GroupStateTimeout.NoTimeout)


def finished(written: DataFrame, scale: float = 3.0, d_weights=(1.0, 0.0, 0.0)) -> DataFrame:
    """What `derivatives` has written, with the signal that the whole series gives now that its stream has ended.

    Where a derivative's robust scores are 0 throughout a series, its scores by mean and deviation of all bins count instead.
    That can't be told bin by bin. Series are few; their numbers, one row each, are joined to all rows.
    """
    totals = [c for n in (1, 2, 3) for c in (F.max(F.abs(f"z{n}")).alias(f"_most{n}"), F.avg(f"d{n}").alias(f"_mean{n}"), F.stddev_pop(f"d{n}").alias(f"_std{n}"))]
    whole = written.groupBy(F.col("series").alias("_series")).agg(*totals)
    df, score = written.join(whole, F.col("series").eqNullSafe(F.col("_series"))), F.lit(0.0)
    for n, w in zip((1, 2, 3), d_weights, strict=True):
        flat = (F.col(f"_most{n}") == 0) & (F.col(f"_std{n}") > 1e-12)
        score = score + w * F.tanh(F.when(flat, (F.col(f"d{n}") - F.col(f"_mean{n}")) / F.col(f"_std{n}")).otherwise(F.col(f"z{n}")) / scale)
    return df.withColumn("signal", unit_interval(score / sum(abs(w) for w in d_weights))).select(*written.columns)
