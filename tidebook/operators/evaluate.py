"""Trade evaluation of signals: detection with cooldown, first hits of take-profit and stop-loss, summaries, labels.

Detection is greedy (a shot blocks those that follow for `cooldown` bins), so it looks like one pass over the
whole series. But all that a stretch of bins needs from its past is how many bins are still blocked where it
begins, a number from 0 to `cooldown`. So each chunk computes what would follow from every such number, the
chunks are then linked by following one number through the table of each, and the shots are read off.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.chunks import CHUNK, over_chunks, spread

TICK, TP, SL, HOLD = 0.25, 8, 4, 1200


def crossings(signals: DataFrame, thresholds: list[float], warmup: int = 0, chunk: int = CHUNK) -> DataFrame:
    """``threshold, bin_seq, direction``: where a signal enters the upper or lower state from another one, per threshold.

    The state before the first bin behind the warm-up is flat. Thresholds multiply rows only where a state is not flat.
    """
    state = lambda x, t: F.when(x >= t, 1).when(x <= -t, -1).otherwise(0)

    def build(df: DataFrame, axis) -> DataFrame:
        return df.withColumn("before", F.coalesce(F.lag("signal").over(axis.ordered), F.lit(0.0)))

    df = over_chunks(signals.filter(F.col("bin_seq") >= warmup), [], "bin_seq", 1, build, chunk=chunk)
    df = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    now, before = state(F.col("signal"), F.col("threshold")), state(F.col("before"), F.col("threshold"))
    return df.filter((now != 0) & (now != before)).select("threshold", "bin_seq", F.when(now == 1, "up").otherwise("down").alias("direction"))


def candidates(predictions: DataFrame, thresholds: list[float], mode: str = "probability", warmup: int = 0) -> DataFrame:
    """``threshold, bin_seq, direction`` of predictions that are sure enough; there is no need of a crossing.

    probability: up at p >= t, down at p <= 1 - t. confidence: |score| >= t, direction by its sign. Null isn't a prediction.
    """
    if mode not in ("probability", "confidence"):
        raise ValueError(f"mode is {mode}, not probability or confidence")
    df = predictions.filter((F.col("bin_seq") >= warmup) & F.col("prediction").isNotNull()).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    p, t = F.col("prediction"), F.col("threshold")
    if mode == "probability":
        direction = F.when(p >= t, "up").when(p <= 1 - t, "down")
    else:
        direction = F.when(F.abs(p) >= t, F.when(p > 0, "up").otherwise("down"))
    return df.select("threshold", "bin_seq", direction.alias("direction")).filter("direction is not null")


def _shots(bins: np.ndarray, free_from: int, cooldown: int) -> list[int]:
    """Positions of the bins that fire when nothing may fire before `free_from`."""
    out, i = [], int(np.searchsorted(bins, free_from))
    while i < len(bins):
        out.append(i)
        i = int(np.searchsorted(bins, bins[i] + max(1, cooldown)))
    return out


def with_cooldown(found: DataFrame, cooldown: int, chunk: int = CHUNK) -> DataFrame:
    """The candidates ``threshold, bin_seq, direction`` that fire: each at least `cooldown` bins after the last one that did."""
    size = max(chunk, cooldown)
    df = found.withColumn("_c", F.floor(F.col("bin_seq") / size))

    def table(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bins, start = np.sort(pdf["bin_seq"].to_numpy()), key[1] * size
        after = []
        for blocked in range(cooldown + 1):
            shots = _shots(bins, start + blocked, cooldown)
            free = bins[shots[-1]] + cooldown if shots else start + blocked
            after.append(int(max(0, free - (start + size))))
        return pd.DataFrame({"threshold": [key[0]], "_c": [key[1]], "after": [after]})

    tables = df.groupBy("threshold", "_c").applyInPandas(table, "threshold double, _c bigint, after array<int>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, blocked, last, out = pdf.sort_values("_c"), 0, None, []
        for c, after in zip(pdf["_c"], pdf["after"], strict=True):
            if last is not None and c != last + 1:
                blocked = 0  # a chunk without candidates is at least as long as the cooldown
            out.append(blocked)
            blocked, last = after[blocked], c
        return pd.DataFrame({"threshold": pdf["threshold"].to_numpy(), "_c": pdf["_c"].to_numpy(), "blocked": out})

    # one row of cooldown + 1 numbers per chunk: a series of a million chunks has some 100 MB here
    entry = tables.groupBy("threshold").applyInPandas(chain, "threshold double, _c bigint, blocked int")

    def fire(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin_seq", ignore_index=True)
        shots = _shots(pdf["bin_seq"].to_numpy(), key[1] * size + int(pdf["blocked"].iloc[0]), cooldown)
        return pdf.iloc[shots][["threshold", "bin_seq", "direction"]]

    return df.join(entry, ["threshold", "_c"]).groupBy("threshold", "_c").applyInPandas(fire, "threshold double, bin_seq bigint, direction string")


def passages(price: np.ndarray, at: np.ndarray, entry: np.ndarray, up: np.ndarray, down: np.ndarray, hold: int) -> np.ndarray:
    """The place of the first price behind each place `at`, fewer than `hold` places away, that moved by `up` or `-down`; -1 if none.

    Binary lifting over the extremes of spans of 1, 2, 4, ... places: a span without a hit is passed over as a
    whole, so an entry costs the logarithm of the hold. Prices of 0 or less are passed over.
    """
    spans = [(np.where(price > 0, price, -np.inf), np.where(price > 0, price, np.inf))]
    while 2 << (len(spans) - 1) < hold:
        (high, low), step = spans[-1], 1 << (len(spans) - 1)
        spans.append((np.maximum(high, np.append(high[step:], np.full(min(step, len(high)), -np.inf))), np.minimum(low, np.append(low[step:], np.full(min(step, len(low)), np.inf)))))
    pos, last = at + 1, np.minimum(at + hold, len(price))
    for level in range(len(spans) - 1, -1, -1):
        high, low = spans[level]
        fits = pos + (1 << level) <= last
        place = np.minimum(pos, len(price) - 1)
        pos = np.where(fits & ~((high[place] - entry >= up) | (low[place] - entry <= -down)), pos + (1 << level), pos)
    place = np.minimum(pos, len(price) - 1)
    hit = (pos < last) & ((spans[0][0][place] - entry >= up) | (spans[0][1][place] - entry <= -down))
    return np.where(hit, pos, -1)


def first_hits(entries: DataFrame, bins: DataFrame, up: Column, down: Column, hold: int, chunk: int = CHUNK) -> DataFrame:
    """The rows of `entries` (with ``bin_seq, entry``) that have a ``hit_bin, hit_price``: the first later bin, fewer than
    `hold` bins away, whose price moves by at least `up` or at most `-down`.

    Chunks of bins, with the `hold` bins behind them, meet the entries of the chunk, and each entry goes through the
    extremes of spans. Bins are dense; prices of 0 or less are passed over.
    """
    columns = entries.columns
    reach = entries.withColumns({"_up": up.cast("double"), "_down": down.cast("double"), "_chunk": F.floor(F.col("bin_seq") / chunk)})
    prices = spread(bins.select("bin_seq", "mid_price"), "bin_seq", 0, hold, chunk)
    prices = prices.select(F.col("_chunk").alias("_block"), F.col("bin_seq").alias("hit_bin"), F.col("mid_price").alias("hit_price"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema) + ", hit_bin bigint, hit_price double"

    def met(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if own.empty or near.empty:
            return pd.DataFrame(columns=[*columns, "hit_bin", "hit_price"]).astype({"hit_bin": "int64", "hit_price": "float64"})
        first, last = int(near["hit_bin"].min()), int(near["hit_bin"].max())
        price = np.zeros(last - first + 1)
        price[near["hit_bin"].to_numpy() - first] = near["hit_price"].to_numpy()
        hit = passages(price, own["bin_seq"].to_numpy() - first, *(own[c].to_numpy() for c in ("entry", "_up", "_down")), hold)
        found = own.loc[hit >= 0, columns].reset_index(drop=True)
        return found.assign(hit_bin=hit[hit >= 0] + first, hit_price=price[hit[hit >= 0]])

    return reach.groupBy("_chunk").cogroup(prices.groupBy("_block")).applyInPandas(met, schema)


def outcomes(shots: DataFrame, bins: DataFrame, tp: float = TP, sl: float = SL, hold: int = HOLD, tick: float = TICK, chunk: int = CHUNK) -> DataFrame:
    """One row per shot: ``threshold, bin_seq, direction, entry_price, outcome, outcome_price, time_to_outcome_ms, pnl_ticks``.

    tp and sl are first hits; else it is a timeout at the last bin of the hold or of the data. Shots at a
    price of 0 or less are left out. `bins` has ``bin_seq, ts_ns, mid_price`` without gaps.
    """
    prices = bins.select("bin_seq", "ts_ns", "mid_price")
    end = prices.agg(F.max("bin_seq")).first()[0]
    entries = shots.join(prices, "bin_seq").filter("mid_price > 0").select("threshold", "bin_seq", "direction", F.col("mid_price").alias("entry"), F.col("ts_ns").alias("entry_ns"))
    up = F.when(F.col("direction") == "up", tp * tick).otherwise(sl * tick)
    down = F.when(F.col("direction") == "up", sl * tick).otherwise(tp * tick)
    hits = first_hits(entries, prices, up, down, hold, chunk).select("threshold", "bin_seq", "hit_bin", "hit_price")
    df = entries.join(hits, ["threshold", "bin_seq"], "left")
    df = df.withColumn("out_bin", F.coalesce("hit_bin", F.least(F.col("bin_seq") + hold, F.lit(end) + 1) - 1))
    out = prices.select(F.col("bin_seq").alias("out_bin"), F.col("ts_ns").alias("out_ns"), F.col("mid_price").alias("out_price"))
    df = df.join(out, "out_bin", "left")
    gain = (F.col("out_price") - F.col("entry")) / tick * F.when(F.col("direction") == "up", 1.0).otherwise(-1.0)
    outcome = F.when(F.col("hit_bin").isNull(), "timeout").when(gain > 0, "tp").otherwise("sl")
    return df.select("threshold", "bin_seq", "direction", F.col("entry").alias("entry_price"), outcome.alias("outcome"), F.col("out_price").alias("outcome_price"), ((F.col("out_ns") - F.col("entry_ns")) / 1e6).alias("time_to_outcome_ms"), gain.alias("pnl_ticks"))


def summary(results: DataFrame, bins: DataFrame, thresholds: list[float], cooldown: int | None = None) -> DataFrame:
    """One row per threshold; without shots the counts are 0 and the rates null."""
    span = bins.agg(((F.max("ts_ns") - F.min("ts_ns")) / 3.6e12).alias("h")).first()["h"] or 0.0
    every = results.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    rate = lambda x: F.avg((F.col("outcome") == x).cast("double")).alias(f"{x}_rate")
    df = results.groupBy("threshold").agg(
        F.count("*").alias("n_signals"), F.count_if(F.col("direction") == "up").alias("n_up"), F.count_if(F.col("direction") == "down").alias("n_down"), rate("tp"), rate("sl"), rate("timeout"),
        F.percentile(F.when(F.col("outcome") != "timeout", F.col("time_to_outcome_ms")), F.lit(0.5)).alias("median_time_to_outcome_ms"), F.avg("pnl_ticks").alias("mean_pnl_ticks"),
    )
    df = every.join(df, "threshold", "left")
    df = df.fillna(0, ["n_signals", "n_up", "n_down"]).withColumn("events_per_hour", F.col("n_signals") / span if span > 0 else F.lit(0.0))
    return df.withColumn("cooldown_bins", F.lit(cooldown)) if cooldown is not None else df


def sweep(signals: DataFrame, bins: DataFrame, thresholds: list[float], cooldown: int, warmup: int, **trade) -> DataFrame:
    """Detect and evaluate for all thresholds at once."""
    shots = with_cooldown(crossings(signals, thresholds, warmup), cooldown)
    return summary(outcomes(shots, bins, **trade), bins, thresholds, cooldown)


def labels(bins: DataFrame, tp: float = TP, sl: float = SL, hold: int = HOLD, tick: float = TICK, chunk: int = CHUNK) -> DataFrame:
    """``bin_seq, label``: the sign of the first move of at least the nearer of the two distances, 0 without one.

    With both distances on both sides, the nearer one is always met first.
    """
    least = F.lit(min(tp, sl) * tick)
    entries = bins.filter("mid_price > 0").select("bin_seq", F.col("mid_price").alias("entry"))
    hits = first_hits(entries, bins, least, least, hold, chunk).select("bin_seq", F.signum(F.col("hit_price") - F.col("entry")).cast("int").alias("label"))
    return bins.select("bin_seq").join(hits, "bin_seq", "left").fillna(0, ["label"])
