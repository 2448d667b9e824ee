"""Queries over the lattice: bins, silver, gold, and the window library."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions import kernels, scalar
from tidebook.functions import windows as W
from tidebook.functions.chunks import apply_chunks, over_chunks
from tidebook.operators import gold as G
from tidebook.operators import joins, quality
from tidebook.queries import sql as S
from tidebook.queries.registry import query, shown
from tidebook.sources import files, market
from tidebook.streaming import telemetry


@query(f"WITH {S.LATTICE} SELECT bin_seq, ts_ns, bin_event_count, event_id, mid_price, best_bid, best_ask FROM bins")
def bin_headers(spark: SparkSession, d: str) -> DataFrame:
    return market.bins(spark, d)


@query(f"WITH {S.LATTICE} SELECT bin_seq, k, v_add, v_pull, v_fill, v_rest_depth, last_event_id FROM cells")
def dense_lattice(spark: SparkSession, d: str) -> DataFrame:
    return market.cells(spark, d)


@query(f"WITH {S.SILVER} SELECT bin_seq, best_ask_move_ticks, best_bid_move_ticks, ask_reprice_sign, bid_reprice_sign, (ask_reprice_sign + 1) * 3 + bid_reprice_sign + 1 AS microstate_id, CASE WHEN ask_reprice_sign > 0 AND bid_reprice_sign > 0 THEN 1 ELSE 0 END AS chase_up_flag, CASE WHEN ask_reprice_sign < 0 AND bid_reprice_sign < 0 THEN 1 ELSE 0 END AS chase_down_flag FROM signs")
def price_moves(spark: SparkSession, d: str) -> DataFrame:
    return market.signs(spark, d)


@query(f"WITH {S.SILVER} SELECT bin_seq, k, {S.rnd('v_add', 'v_pull', 'v_fill', 'v_rest_depth', 'a_add', 'a_pull', 'a_fill', 'j_add', 'j_pull', 'j_fill')}, ask_reprice_sign, bid_reprice_sign FROM silver")
def silver_grid(spark: SparkSession, d: str) -> DataFrame:
    return shown(market.silver(spark, d), "bin_seq", "k", *[f"v_{x}" for x in ("add", "pull", "fill", "rest_depth")], *[f"{a}_{x}" for a in "aj" for x in ("add", "pull", "fill")], "ask_reprice_sign", "bid_reprice_sign")


@query(f"WITH {S.FORCES} SELECT bin_seq, k, {S.rnd('pressure_variant', 'vacuum_variant', 'composite', 'composite_d1', 'composite_d2', 'composite_d3')} FROM forces")
def gold_forces(spark: SparkSession, d: str) -> DataFrame:
    return shown(G.force_block(market.silver(spark, d)), "bin_seq", "k", "pressure_variant", "vacuum_variant", "composite", "composite_d1", "composite_d2", "composite_d3")


@query(f"WITH {S.GOLD} SELECT bin_seq, k, {S.rnd('composite', 'flow_score')}, state5_code, flow_state_code FROM gold")
def gold_grid(spark: SparkSession, d: str) -> DataFrame:
    return shown(G.gold(market.silver(spark, d)), "bin_seq", "k", "composite", "flow_score", "state5_code", "flow_state_code")


@query(f"WITH {S.SILVER}, w AS (SELECT bin_seq, k, avg(v_add) OVER a AS mean5, stddev_samp(v_add) OVER a AS std5, min(v_add) OVER a AS min5, max(v_add) OVER a AS max5, sum(v_add) OVER a AS sum5, sum(v_add) OVER b / 20 AS padded20, CASE WHEN bin_seq >= 19 THEN avg(v_add) OVER b ELSE 0 END AS full20, CASE WHEN bin_seq >= 19 THEN stddev_pop(v_add) OVER b ELSE 0 END AS fullstd20, coalesce(lag(v_add, 5) OVER c, 0) AS lag5, (v_add - avg(v_add) OVER b) / (stddev_samp(v_add) OVER b + 1e-12) AS z20 FROM silver WINDOW a AS (PARTITION BY k ORDER BY bin_seq ROWS 4 PRECEDING), b AS (PARTITION BY k ORDER BY bin_seq ROWS 19 PRECEDING), c AS (PARTITION BY k ORDER BY bin_seq)) SELECT bin_seq, k, {S.rnd('mean5', 'std5', 'min5', 'max5', 'sum5', 'padded20', 'full20', 'fullstd20', 'lag5', 'z20')} FROM w")
def rolling_windows(spark: SparkSession, d: str) -> DataFrame:
    def build(df: DataFrame, axis) -> DataFrame:
        new = {f"{how}5": W.trailing(axis, "v_add", 5, how) for how in ("mean", "std", "min", "max", "sum")}
        new |= {"padded20": W.padded_mean(axis, "v_add", 20), "full20": W.full_mean(axis, "v_add", 20), "fullstd20": W.full_std(axis, "v_add", 20), "lag5": W.lagged(axis, "v_add", 5), "z20": W.z_score(axis, "v_add", 20)}
        return df.withColumns(new)

    df = over_chunks(market.cells(spark, d).select("bin_seq", "k", "v_add"), ["k"], "bin_seq", 20, build)
    return shown(df.drop("v_add"))


@query(f"WITH {S.LATTICE}, w AS (SELECT bin_seq, {S.slope('mid_price', 10)} AS slope10, {S.slope('mid_price', 50)} AS slope50 FROM bins) SELECT bin_seq, {S.rnd('slope10', 'slope50')} FROM w")
def rolling_slopes(spark: SparkSession, d: str) -> DataFrame:
    def build(df: DataFrame, axis) -> DataFrame:
        return df.withColumns({"slope10": W.slope(axis, "mid_price", 10), "slope50": W.slope(axis, "mid_price", 50)})

    return shown(over_chunks(market.bins(spark, d).select("bin_seq", "mid_price"), [], "bin_seq", 50, build), "bin_seq", "slope10", "slope50")


@query(f"WITH {S.LATTICE}, m AS (SELECT bin_seq, avg(mid_price) OVER w AS m1, avg(mid_price * mid_price) OVER w AS m2, avg(mid_price * mid_price * mid_price) OVER w AS m3, var_pop(mid_price) OVER w AS v FROM bins WINDOW w AS (ORDER BY bin_seq ROWS 49 PRECEDING)), s AS (SELECT bin_seq, CASE WHEN bin_seq >= 49 AND v > 1e-12 THEN (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / pow(v, 15e-1) ELSE 0 END AS skew50 FROM m) SELECT bin_seq, round(skew50, 5) + 0e0 AS skew50 FROM s")
def rolling_skew(spark: SparkSession, d: str) -> DataFrame:
    df = over_chunks(market.bins(spark, d).select("bin_seq", "mid_price"), [], "bin_seq", 50, lambda p, axis: p.withColumn("skew50", W.full_skew(axis, "mid_price", 50)))
    return shown(df.drop("mid_price"), digits=5)


@query(f"WITH {S.LATTICE}, w AS (SELECT bin_seq, k, {S.robust_z('v_add', 100, 30, 'k')} AS z FROM cells) SELECT bin_seq, k, {S.rnd('z')} FROM w")
def robust_z_scores(spark: SparkSession, d: str) -> DataFrame:
    df = market.cells(spark, d).select("bin_seq", "k", "v_add")
    df = apply_chunks(df, ["k"], "bin_seq", 100, lambda p: pd.DataFrame({"z": kernels.robust_z(p["v_add"].to_numpy(), 100, 30)}), "z double")
    return shown(df.drop("v_add"))


_EMAS = {5: 0.4, 10: 0.3, 20: 0.2, 50: 0.1}


@query(f"WITH {S.LATTICE}, e AS (SELECT bin_seq, mid_price, {', '.join(f'{S.ema('mid_price', f'(2e0 / {n + 1})')} AS ema{n}' for n in _EMAS)}, avg(mid_price) OVER (ORDER BY bin_seq ROWS 9 PRECEDING) AS sma10 FROM bins), m AS (SELECT *, tanh((4e-1 * sign(ema5 - ema10) + 3e-1 * sign(ema10 - ema20) + 2e-1 * sign(ema20 - ema50)) / 9e-1) AS ensemble FROM e) SELECT bin_seq, {S.rnd('ema5', 'ema10', 'ema20', 'ema50', 'sma10', 'ensemble')} FROM m")
def ema_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Moving averages of several periods and tanh of the weighted signs of their differences, slower from faster."""
    df = market.bins(spark, d).select("bin_seq", "mid_price")

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        x = p["mid_price"].to_numpy()
        return pd.DataFrame({f"ema{n}": kernels.ema(x, 2 / (n + 1)) for n in _EMAS} | {"sma10": kernels.trailing_mean(x, 10)})

    df = apply_chunks(df, [], "bin_seq", kernels.ema_halo(2 / 51), kernel, ", ".join(f"{c} double" for c in (*[f"ema{n}" for n in _EMAS], "sma10")))
    pairs, weights = list(zip([5, 10, 20], [10, 20, 50], strict=True)), [0.4, 0.3, 0.2]
    total = sum(w * F.signum(F.col(f"ema{a}") - F.col(f"ema{b}")) for (a, b), w in zip(pairs, weights, strict=True))
    return shown(df.withColumn("ensemble", F.tanh(total / sum(weights))).drop("mid_price"))


@query(f"WITH {S.LATTICE}, e AS (SELECT bin_seq, {S.ema('abs(mid_price)', '5e-2')} AS magnitude, list_reduce(list(mid_price) OVER (ORDER BY bin_seq), lambda m, y: greatest(995e-3 * m, y)) AS decayed, mid_price FROM bins), n AS (SELECT bin_seq, mid_price / greatest(magnitude, 1e-6) AS normalised, mid_price / greatest(decayed, 1e-6) AS share FROM e) SELECT bin_seq, {S.rnd('normalised', 'share')} FROM n")
def running_magnitudes(spark: SparkSession, d: str) -> DataFrame:
    """A value over its running mean magnitude, and over its decayed running maximum."""
    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        x = p["mid_price"].to_numpy()
        over = lambda scale: x / np.maximum(scale, 1e-6)
        return pd.DataFrame({"normalised": over(kernels.ema(abs(x), 0.05)), "share": over(kernels.decayed_max(x, 0.995))})

    # 0.995 ** 8300 is below what a double can tell, so the maximum needs no more of the past
    df = apply_chunks(market.bins(spark, d).select("bin_seq", "mid_price"), [], "bin_seq", 8300, kernel, "normalised double, share double", chunk=16384)
    return shown(df.drop("mid_price"))


@query(f"WITH {S.LATTICE}, w AS (SELECT bin_seq, k, avg(v_add) OVER a AS mean2, stddev_samp(v_add) OVER a AS std2, sum(v_add) OVER a AS sum2, max(v_add) OVER a AS max2, CASE WHEN k = -5 THEN lead(v_add) OVER b - v_add WHEN k = 5 THEN v_add - lag(v_add) OVER b ELSE (lead(v_add) OVER b - lag(v_add) OVER b) / 2 END AS gradient, lead(v_add) OVER b + lag(v_add) OVER b - 2 * v_add AS curvature FROM cells WINDOW a AS (PARTITION BY bin_seq ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), b AS (PARTITION BY bin_seq ORDER BY k)) SELECT bin_seq, k, {S.rnd('mean2', 'std2', 'sum2', 'max2', 'gradient', 'curvature')} FROM w")
def spatial_windows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("bin_seq").orderBy("k")
    a, x, r = w.rowsBetween(-2, 2), F.col("v_add"), market.RADIUS
    up, down = F.lead(x).over(w), F.lag(x).over(w)
    gradient = F.when(F.col("k") == -r, up - x).when(F.col("k") == r, x - down).otherwise((up - down) / 2)
    df = market.cells(spark, d).select("bin_seq", "k", F.avg(x).over(a).alias("mean2"), F.stddev_samp(x).over(a).alias("std2"), F.sum(x).over(a).alias("sum2"), F.max(x).over(a).alias("max2"), gradient.alias("gradient"), (up + down - 2 * x).alias("curvature"))
    return shown(df)


@query(f"WITH {S.GOLD}, p1 AS (SELECT bin_seq, k, flow_score AS s, CASE WHEN bin_seq > 0 THEN (flow_score - lag(flow_score) OVER w) / 1e-1 ELSE 0 END AS s1 FROM gold WINDOW w AS (PARTITION BY k ORDER BY bin_seq)), p2 AS (SELECT *, CASE WHEN bin_seq > 0 THEN (s1 - lag(s1) OVER w) / 1e-1 ELSE 0 END AS s2 FROM p1 WINDOW w AS (PARTITION BY k ORDER BY bin_seq)), p AS (SELECT bin_seq, k, {', '.join(f'greatest(-1e0, least(1e0, (s + s1 * {h} + 5e-1 * s2 * {h} * {h}) * exp(-2e0 * {h}))) AS ahead{i}' for i, h in enumerate(('1e-1', '2e-1', '3e-1', '4e-1'), 1))} FROM p2) SELECT bin_seq, k, {S.rnd('ahead1', 'ahead2', 'ahead3', 'ahead4')} FROM p")
def score_projections(spark: SparkSession, d: str) -> DataFrame:
    """Flow scores one to four bins ahead by their time derivatives, damped."""
    def build(df: DataFrame, axis) -> DataFrame:
        d1, d2, d3 = W.derivatives(axis, "flow_score", 0.1, strict=False)
        return df.withColumns({"s1": d1, "s2": d2, "s3": d3})

    df = over_chunks(G.gold(market.silver(spark, d)).select("bin_seq", "k", "flow_score"), ["k"], "bin_seq", 4, build)
    ahead = {f"ahead{i}": scalar.projection(F.col("flow_score"), F.col("s1"), F.col("s2"), F.col("s3"), i / 10, damp=2.0) for i in (1, 2, 3, 4)}
    return shown(df.select("bin_seq", "k", *[c.alias(n) for n, c in ahead.items()]))


@query(f"WITH {S.LATTICE}, s AS (SELECT bin_seq, k, sum(cents) AS x FROM ev GROUP BY bin_seq, k) SELECT bin_seq, {', '.join(f'CAST(coalesce(sum(x) FILTER (k = {k}), 0) AS DOUBLE) AS at{k + 3}' for k in range(-3, 4))} FROM s GROUP BY bin_seq HAVING count(*) FILTER (k BETWEEN -3 AND 3) > 0")
def dense_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Sparse cells as one array per bin, absent positions 0, positions beyond the radius dropped."""
    events = market.table(spark, d, "events")
    t0, _ = market.span(events)
    sparse = market.binned(events, t0).groupBy("bin_seq", "k").agg(F.sum("cents").alias("x"))
    return joins.dense(sparse, "bin_seq", "k", 3, "x").select("bin_seq", *[F.col("values")[i].alias(f"at{i}") for i in range(7)])


@query(f"WITH {S.LATTICE}, v AS (SELECT lag(bin_seq) OVER w AS b, lag(ts_ns) OVER w AS t, * FROM bins WINDOW w AS (ORDER BY bin_seq)) SELECT unnest(['sequence', 'time', 'spread', 'count', 'price', 'empty_price']) AS rule, unnest([count(*) FILTER (bin_seq <> b + 1), count(*) FILTER (ts_ns <= t), count(*) FILTER (best_ask < best_bid), count(*) FILTER (bin_event_count < 0), count(*) FILTER (mid_price < 0), count(*) FILTER (bin_event_count = 0 AND mid_price <> 0)]) AS n_bad, count(*) AS n_rows FROM v")
def header_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.header_checks(market.bins(spark, d))


@query(f"WITH {S.GOLD} SELECT unnest(['score', 'flow_state', 'state5', 'finite_composite']) AS rule, unnest([count(*) FILTER (abs(flow_score) > 1), count(*) FILTER (flow_state_code NOT IN (-1, 0, 1)), count(*) FILTER (state5_code NOT BETWEEN -2 AND 2), count(*) FILTER (composite IS NULL OR NOT isfinite(composite))]) AS n_bad, count(*) AS n_rows FROM gold")
def gold_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.gold_checks(G.gold(market.silver(spark, d))).filter(F.col("rule").isin("score", "flow_state", "state5", "finite_composite"))


@query(f"WITH {S.FORCES} SELECT bin_seq, k, 'demo__' || bin_seq || '__' || k AS entity_key, 'demo' AS dataset_id, make_timestamp(ts_ns // 1000) AS event_timestamp, {S.rnd('pressure_variant', 'vacuum_variant')} FROM forces JOIN bins USING (bin_seq)")
def feature_view(spark: SparkSession, d: str) -> DataFrame:
    grid = G.force_block(market.silver(spark, d)).select("bin_seq", "k", "pressure_variant", "vacuum_variant")
    view = files.feature_view(grid, market.bins(spark, d), "demo").withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp_ntz"))
    return shown(view, "bin_seq", "k", "entity_key", "dataset_id", "event_timestamp", "pressure_variant", "vacuum_variant")


@query(f"WITH {S.LATTICE} SELECT bin_seq, k, 'demo__' || bin_seq || '__' || k AS entity_key FROM nb CROSS JOIN kk")
def entity_frame(spark: SparkSession, d: str) -> DataFrame:
    return files.entity_frame(market.bins(spark, d).select("bin_seq"), market.RADIUS, "demo")


@query(f"WITH {S.LATTICE} SELECT bin_seq, k FROM cells WHERE abs(v_add) + abs(v_pull) + abs(v_fill) + abs(v_rest_depth) > 0")
def active_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells in which something moved."""
    return quality.active(market.cells(spark, d), ["v_add", "v_pull", "v_fill", "v_rest_depth"]).select("bin_seq", "k")


@query(f"WITH {S.LATTICE} SELECT bin_seq, ts_ns, mid_price FROM bins WHERE ts_ns >= 1704240000000000000 AND ts_ns < 1704412800000000000")
def evaluation_window(spark: SparkSession, d: str) -> DataFrame:
    """Bins of the evaluation, 3 and 4 January 2024."""
    return quality.between(market.bins(spark, d), 1_704_240_000_000_000_000, 1_704_412_800_000_000_000).select("bin_seq", "ts_ns", "mid_price")


@query(f"WITH {S.LATTICE} SELECT bin_seq, v_add, v_pull, v_fill, v_rest_depth FROM cells WHERE k = 0")
def spot_level(spark: SparkSession, d: str) -> DataFrame:
    """The variant of the lattice with one row a bin, that of the spot."""
    return market.cells(spark, d).filter("k = 0").select("bin_seq", "v_add", "v_pull", "v_fill", "v_rest_depth")


@query(f"WITH {S.GOLD} SELECT bin_seq, k, {S.rnd('flow_score')}, flow_state_code FROM gold")
def batch_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a grid that is checked to have all cells of every bin."""
    grid = G.force_block(quality.dense(market.silver(spark, d), 11))
    return shown(G.scored(grid), "bin_seq", "k", "flow_score", "flow_state_code")


@query(f"WITH {S.LATTICE}, r AS (SELECT bin_seq AS number, CAST(bin_event_count AS DOUBLE) AS x FROM bins) SELECT number, n, round(p[1], 6) AS p50, round(p[2], 6) AS p95, round(p[3], 6) AS p99 FROM (SELECT number, count(*) OVER w AS n, quantile_cont(x, [5e-1, 95e-2, 99e-2]) OVER w AS p FROM r WINDOW w AS (ORDER BY number ROWS 199 PRECEDING)) WHERE (number + 1) % 50 = 0")
def latency_windows(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the last 200 records at every 50th; a bin's number of events stands for its latency."""
    records = market.bins(spark, d).select(F.col("bin_seq").alias("number"), F.col("bin_event_count").cast("double").alias("x"))
    return shown(telemetry.summaries(records, "x"))
