"""Queries over signals, their evaluation and the stored results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.chunks import over_chunks
from tidebook.functions.quantiles import percentiles
from tidebook.operators import evaluate as E
from tidebook.operators import gold as G
from tidebook.operators import quality, results
from tidebook.operators import signals as X
from tidebook.queries import sql as S
from tidebook.queries.registry import query, shown
from tidebook.sources import files, market

R = market.RADIUS
THRESHOLDS = [0.05, 0.1, 0.2, 0.4]
COOLDOWN, WARMUP, HOLD = 5, 40, 60


def full_lattice(spark: SparkSession, d: str) -> DataFrame:
    """Silver and gold columns on one lattice."""
    silver = market.silver(spark, d)
    return silver.join(G.gold(silver), ["bin_seq", "k"], "left")


def forces(spark: SparkSession, d: str) -> DataFrame:
    return G.force_block(market.silver(spark, d))


def out(df: DataFrame) -> DataFrame:
    return shown(df, "bin_seq", "signal")


# ---- per-bin reductions in SQL

def _mean(x: str, lo: int, hi: int, sign: int) -> str:
    return f"avg(CASE WHEN k * {sign} BETWEEN {lo} AND {hi} THEN {x} END)"


def _asym(x: str, lo: int, hi: int, pull: bool) -> str:
    bid, ask = _mean(x, lo, hi, -1), _mean(x, lo, hi, 1)
    return f"({ask} - {bid})" if pull else f"({bid} - {ask})"


_BANDS = X.bands_within(R)
_W = [f"(1e0 / sqrt({hi - lo + 1}))" for lo, hi in _BANDS]
_COMBINED = f"({' + '.join(f'{w} * ({_asym('v_add', lo, hi, False)} + {_asym('v_pull', lo, hi, True)})' for (lo, hi), w in zip(_BANDS, _W, strict=True))}) / ({' + '.join(_W)})"
_ADS = f"""a1 AS (SELECT bin_seq, {_COMBINED} AS x FROM silver GROUP BY bin_seq),
a2 AS (SELECT bin_seq, x, {', '.join(f'{S.slope("x", n)} AS s{n}' for n in (10, 25, 50))} FROM a1)"""


def _z_full(x: str, window: int, least: int, first: int) -> str:
    """A robust z of a column that is NULL in its first rows; windows with a NULL give 0."""
    w = f"(ORDER BY bin_seq ROWS {window - 1} PRECEDING)"
    full = f"count({x}) OVER {w} = least({window}, bin_seq + 1)"
    scale = f"1.4826e0 * mad({x}) OVER {w}"
    return f"CASE WHEN {full} AND bin_seq + 1 >= {least} AND {scale} > 1e-12 THEN ({x} - median({x}) OVER {w}) / ({scale}) ELSE 0 END"


@query(f"WITH {S.SILVER}, {_ADS}, z AS (SELECT bin_seq, 40e-2 * tanh({_z_full('s10', 200, 30, 9)} / 3e0) + 35e-2 * tanh({_z_full('s25', 200, 30, 24)} / 3e0) + 25e-2 * tanh({_z_full('s50', 200, 30, 49)} / 3e0) AS signal FROM a2) SELECT bin_seq, {S.rnd('signal')} FROM z")
def signal_ads(spark: SparkSession, d: str) -> DataFrame:
    return out(X.compute("ads", market.silver(spark, d), R))


_GRAD = "CASE WHEN k = -5 THEN lead({x}) OVER w - {x} WHEN k = 5 THEN {x} - lag({x}) OVER w ELSE (lead({x}) OVER w - lag({x}) OVER w) / 2 END"
_SPG = f"""g1 AS (SELECT bin_seq, k, {_GRAD.format(x='pressure_variant')} AS gp, {_GRAD.format(x='vacuum_variant')} AS gv, lead(pressure_variant) OVER w + lag(pressure_variant) OVER w - 2 * pressure_variant AS bend FROM forces WINDOW w AS (PARTITION BY bin_seq ORDER BY k)),
g2 AS (SELECT bin_seq, -({_mean('gp', 1, 5, -1)} - {_mean('gp', 1, 5, 1)}) + ({_mean('gv', 1, 5, 1)} - {_mean('gv', 1, 5, -1)}) AS net, -avg(CASE WHEN abs(k) <= 2 THEN bend END) AS curve FROM g1 GROUP BY bin_seq),
spg AS (SELECT bin_seq, 7e-1 * (6e-1 * {S.ema('net', '(2e0 / 6)')} + 4e-1 * {S.ema('net', '(2e0 / 21)')}) + 3e-1 * {S.ema('curve', '(2e0 / 11)')} AS signal FROM g2)"""


@query(f"WITH {S.FORCES}, {_SPG} SELECT bin_seq, {S.rnd('signal')} FROM spg")
def signal_spg(spark: SparkSession, d: str) -> DataFrame:
    return out(X.compute("spg", forces(spark, d), R))


def _h(cells: str, n: int) -> str:
    p = lambda v: f"(CAST(count(*) FILTER ({cells} AND flow_state_code = {v}) AS DOUBLE) / {n})"
    return "(" + " + ".join(f"CASE WHEN {p(v)} > 0 THEN -{p(v)} * log2({p(v)} + 1e-12) ELSE 0 END" for v in (1, -1, 0)) + ")"


_ERD = f"h1 AS (SELECT bin_seq, {_h('true', 11)} AS h, {_h('k > 0', 5)} - {_h('k < 0', 5)} AS b, {_mean('flow_score', 1, 5, -1)} - {_mean('flow_score', 1, 5, 1)} AS a FROM gold GROUP BY bin_seq)"


@query(f"WITH {S.GOLD}, {_ERD}, z AS (SELECT bin_seq, a * greatest(0e0, {S.robust_z('h', 100, 30)} - 5e-1) AS signal FROM h1) SELECT bin_seq, {S.rnd('signal')} FROM z")
def signal_erd(spark: SparkSession, d: str) -> DataFrame:
    return out(X.compute("erd", G.gold(market.silver(spark, d)), R))


@query(f"WITH {S.GOLD}, {_ERD} SELECT bin_seq, {S.rnd('h', 'b')} FROM h1")
def state_entropy(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    df = G.gold(market.silver(spark, d)).groupBy("bin_seq").agg(X.entropy("flow_state_code", F.lit(True), 11).alias("h"), (X.entropy("flow_state_code", k > 0, 5) - X.entropy("flow_state_code", k < 0, 5)).alias("b"))
    return shown(df)


_ZONES = ", ".join(f"{_mean(x, lo, hi, sign)} AS {n}_{z}_{side}" for n, x in (("add", "(v_add + v_fill)"), ("pull", "v_pull")) for side, sign in (("bid", -1), ("ask", 1)) for z, lo, hi in (("in", 1, 3), ("out", 5, 5)))


def _lead(n: str, side: str, lag: int) -> str:
    i, o = f"{n}_in_{side}", f"{n}_out_{side}"
    return f"{S.ema(f'{i}_{o}_p', '1e-1')} / ({S.ema(f'{i} * {o}', '1e-1')} + 1e-12)"


_PROD = ", ".join(f"{n}_in_{s} * coalesce(lag({n}_out_{s}, 5) OVER (ORDER BY bin_seq), 0) AS {n}_in_{s}_{n}_out_{s}_p" for n in ("add", "pull") for s in ("bid", "ask"))
_PFP = f"""f1 AS (SELECT bin_seq, {_ZONES} FROM silver GROUP BY bin_seq), f2 AS (SELECT *, {_PROD} FROM f1),
pfp AS (SELECT bin_seq, 6e-1 * ({_lead('add', 'bid', 5)} - {_lead('add', 'ask', 5)}) + 4e-1 * ({_lead('pull', 'ask', 5)} - {_lead('pull', 'bid', 5)}) AS signal FROM f2)"""


@query(f"WITH {S.SILVER}, {_PFP} SELECT bin_seq, round(signal, 4) + 0e0 AS signal FROM pfp")
def signal_pfp(spark: SparkSession, d: str) -> DataFrame:
    return shown(X.compute("pfp", market.silver(spark, d), R), digits=4)


def _inv(x: str, sign: int) -> str:
    w = f"CASE WHEN k * {sign} BETWEEN 1 AND 5 THEN 1e0 / (k * {sign}) END"
    return f"(sum({w} * {x}) / sum({w}))"


def _div(c: str) -> str:
    return f"5e-1 * ({_inv(c + '_add', -1)} - {_inv(c + '_add', 1)}) + 5e-1 * ({_inv(c + '_pull', 1)} - {_inv(c + '_pull', -1)})"


@query(f"WITH {S.SILVER}, j1 AS (SELECT bin_seq, {_div('j')} AS j, {_div('a')} AS a FROM silver GROUP BY bin_seq), j2 AS (SELECT bin_seq, CASE WHEN sign(j) = sign(a) THEN 4e-1 * j + 6e-1 * a ELSE 8e-1 * j + 2e-1 * a END AS x FROM j1), z AS (SELECT bin_seq, tanh({S.robust_z('x', 300, 30)} / 3e0) AS signal FROM j2) SELECT bin_seq, {S.rnd('signal')} FROM z")
def signal_jad(spark: SparkSession, d: str) -> DataFrame:
    return out(X.compute("jad", market.silver(spark, d), R))


def _side(x: str, sign: int) -> str:
    return f"coalesce(sum(CASE WHEN k * {sign} BETWEEN 1 AND 16 THEN {x} END), 0)"


_IIRC = f"""i1 AS (SELECT bin_seq, ln({_side('v_add', -1)} / ({_side('v_pull', -1)} + {_side('v_fill', -1)} + 1) + 1) - ln({_side('v_add', 1)} / ({_side('v_pull', 1)} + {_side('v_fill', 1)} + 1) + 1) AS x FROM silver GROUP BY bin_seq),
iirc AS (SELECT bin_seq, CASE WHEN abs(x) >= 1e-1 THEN coalesce(6e-1 * {S.slope('x', 10)} + 4e-1 * {S.slope('x', 30)}, 0) ELSE 0 END AS signal FROM i1)"""


@query(f"WITH {S.SILVER}, {_IIRC} SELECT bin_seq, {S.rnd('signal')} FROM iirc")
def signal_iirc(spark: SparkSession, d: str) -> DataFrame:
    return out(X.compute("iirc", market.silver(spark, d), R))


_MSD = "msd AS (SELECT bin_seq, sum(CASE WHEN k > 0 THEN vacuum_variant / k ELSE 0 END) - sum(CASE WHEN k < 0 THEN vacuum_variant / -k ELSE 0 END) AS signal FROM forces GROUP BY bin_seq)"


@query(f"WITH {S.FORCES}, {_MSD} SELECT bin_seq, {S.rnd('signal')} FROM msd")
def signal_msd(spark: SparkSession, d: str) -> DataFrame:
    return out(X.compute("msd", forces(spark, d), R))


_DER = f"""s1 AS (SELECT bin_seq, CAST(count(*) FILTER (state5_code > 0) - count(*) FILTER (state5_code < 0) AS DOUBLE) / 11 AS base FROM forces GROUP BY bin_seq),
s2 AS (SELECT bin_seq, CASE WHEN bin_seq > 0 THEN (base - lag(base) OVER (ORDER BY bin_seq)) / 1e-1 ELSE 0 END AS d1 FROM s1),
s3 AS (SELECT bin_seq, d1, {S.robust_z('d1', 300, 75)} AS z FROM s2),
der AS (SELECT bin_seq, tanh(CASE WHEN max(abs(z)) OVER () > 0 THEN z WHEN stddev_pop(d1) OVER () > 1e-12 THEN (d1 - avg(d1) OVER ()) / stddev_pop(d1) OVER () ELSE 0 END / 3e0) AS signal FROM s3)"""


@query(f"WITH {S.FORCES}, {_DER} SELECT bin_seq, {S.rnd('signal')} FROM der")
def signal_derivative(spark: SparkSession, d: str) -> DataFrame:
    df = forces(spark, d).withColumn("state5_code", G.state5(F.col("k"), F.col("ask_reprice_sign"), F.col("bid_reprice_sign")))
    return out(X.compute("derivative", df, R))


_MIX = f"""m1 AS (SELECT bin_seq, {_COMBINED} AS x, sum(CASE WHEN k > 0 THEN vacuum_variant / k ELSE 0 END) - sum(CASE WHEN k < 0 THEN vacuum_variant / -k ELSE 0 END) AS vac, {_ZONES} FROM forces GROUP BY bin_seq),
m2 AS (SELECT *, {', '.join(f'{S.slope("x", n)} AS s{n}' for n in (10, 25, 50))}, {_PROD} FROM m1),
m3 AS (SELECT bin_seq, 40e-2 * tanh({_z_full('s10', 200, 30, 9)} / 3e0) + 35e-2 * tanh({_z_full('s25', 200, 30, 24)} / 3e0) + 25e-2 * tanh({_z_full('s50', 200, 30, 49)} / 3e0) AS ads,
       6e-1 * ({_lead('add', 'bid', 5)} - {_lead('add', 'ask', 5)}) + 4e-1 * ({_lead('pull', 'ask', 5)} - {_lead('pull', 'bid', 5)}) AS pfp, vac / greatest({S.ema('abs(vac)', '5e-2')}, 1e-6) AS svac FROM m2),
mix AS (SELECT bin_seq, (CASE WHEN bin_seq >= 199 THEN 4e-1 * ads ELSE 0 END + CASE WHEN bin_seq >= 4 THEN 3e-1 * pfp ELSE 0 END + 3e-1 * svac) / (CASE WHEN bin_seq >= 199 THEN 4e-1 ELSE 0 END + CASE WHEN bin_seq >= 4 THEN 3e-1 ELSE 0 END + 3e-1) AS signal FROM m3)"""


@query(f"WITH {S.FORCES}, {_MIX} SELECT bin_seq, round(signal, 4) + 0e0 AS signal FROM mix")
def signal_ads_pfp_svac(spark: SparkSession, d: str) -> DataFrame:
    return shown(X.compute("ads_pfp_svac", forces(spark, d), R), digits=4)


_EDGE = f"""e1 AS (SELECT bin_seq, ({' + '.join(f'(1e0 / sqrt({b})) * {_asym("c", 1, b, False)}' for b in (4, 8, 16))}) / ({' + '.join(f'(1e0 / sqrt({b}))' for b in (4, 8, 16))}) AS x FROM raw GROUP BY bin_seq),
edge AS (SELECT bin_seq, ({' + '.join(f'(1e0 / sqrt({n})) * avg(x) OVER (ORDER BY bin_seq ROWS {n - 1} PRECEDING)' for n in (25, 50, 100, 200))}) / ({' + '.join(f'(1e0 / sqrt({n}))' for n in (25, 50, 100, 200))}) AS signal FROM e1)"""


@query(f"WITH {S.FORCES}, {_EDGE} SELECT bin_seq, {S.rnd('signal')} FROM edge")
def directional_edge(spark: SparkSession, d: str) -> DataFrame:
    return out(X.directional_edge(forces(spark, d), R))


@query(f"WITH {S.SILVER} SELECT bin_seq, {', '.join(f'round({_asym(x, lo, hi, p)}, 6) + 0e0 AS {x}_{lo}_{hi}' for x, p in (('v_add', False), ('v_pull', True)) for lo, hi in _BANDS)}, round({_inv('v_add', -1)}, 6) + 0e0 AS near_bid, round({_inv('v_add', 1)}, 6) + 0e0 AS near_ask FROM silver GROUP BY bin_seq")
def band_asymmetries(spark: SparkSession, d: str) -> DataFrame:
    bands = [X.asymmetry(x, lo, hi, p).alias(f"{x}_{lo}_{hi}") for x, p in (("v_add", False), ("v_pull", True)) for lo, hi in _BANDS]
    return shown(market.silver(spark, d).groupBy("bin_seq").agg(*bands, X.inverse_mean("v_add", 5, -1).alias("near_bid"), X.inverse_mean("v_add", 5, 1).alias("near_ask")))


@query(f"WITH {S.FORCES}, i AS (SELECT bin_seq, count(*) FILTER (state5_code = -2) AS c0, count(*) FILTER (state5_code = -1) AS c1, count(*) FILTER (state5_code = 0) AS c2, count(*) FILTER (state5_code = 1) AS c3, count(*) FILTER (state5_code = 2) AS c4 FROM forces GROUP BY bin_seq), dom AS (SELECT bin_seq, CASE greatest(c0, c1, c2, c3, c4) WHEN c0 THEN -2 WHEN c1 THEN -1 WHEN c2 THEN 0 WHEN c3 THEN 1 ELSE 2 END AS s FROM i), tr AS (SELECT lag(s) OVER (ORDER BY bin_seq) AS src, s AS dst FROM dom) SELECT src, dst, count(*) AS n FROM tr WHERE src IS NOT NULL GROUP BY src, dst")
def state_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Transitions between the dominant states of bins; of equal shares the most bearish dominates."""
    df = forces(spark, d).withColumn("state5_code", G.state5(F.col("k"), F.col("ask_reprice_sign"), F.col("bid_reprice_sign")))
    shares = df.groupBy("bin_seq").agg(*[F.count_if(F.col("state5_code") == s).alias(f"c{s + 2}") for s in range(-2, 3)])
    values = F.array(*[F.col(f"c{i}") for i in range(5)])
    dominant = shares.select("bin_seq", (F.array_position(values, F.array_max(values)) - 3).cast("int").alias("dst"))
    moves = over_chunks(dominant, [], "bin_seq", 1, lambda p, axis: p.withColumn("src", F.lag("dst").over(axis.ordered)))
    return moves.filter("src is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {S.FORCES} SELECT (ask_reprice_sign + 1) * 3 + bid_reprice_sign + 1 AS microstate_id, count(*) AS n FROM forces WHERE k = 0 GROUP BY 1")
def microstate_counts(spark: SparkSession, d: str) -> DataFrame:
    return market.signs(spark, d).groupBy("microstate_id").agg(F.count("*").alias("n")).withColumn("microstate_id", F.col("microstate_id").cast("int"))


@query(f"WITH {S.FORCES}, {_MSD}, p AS (SELECT unnest(quantile_cont(abs(signal), [5e-1, 7e-1, 8e-1, 9e-1, 95e-2, 99e-2])) AS x FROM msd WHERE bin_seq >= 300) SELECT DISTINCT round(x, 6) AS threshold FROM p WHERE round(x, 6) > 0")
def adaptive_thresholds(spark: SparkSession, d: str) -> DataFrame:
    t = X.adaptive_thresholds(X.compute("msd", forces(spark, d), R), "msd")
    return t.select(F.explode("thresholds").alias("threshold"))


@query(f"WITH {S.FORCES}, s AS (SELECT bin_seq, sum(CASE WHEN k > 0 THEN pressure_variant ELSE 0 END) AS p_above, sum(CASE WHEN k < 0 THEN pressure_variant ELSE 0 END) AS p_below, sum(CASE WHEN k > 0 THEN vacuum_variant ELSE 0 END) AS v_above, sum(CASE WHEN k < 0 THEN vacuum_variant ELSE 0 END) AS v_below FROM forces GROUP BY bin_seq), n AS (SELECT *, (p_below - p_above) + (v_above - v_below) AS net_edge FROM s) SELECT bin_seq, {S.rnd('p_above', 'p_below', 'v_above', 'v_below', 'net_edge')}, CASE WHEN net_edge >= 5 THEN 'strong_up' WHEN net_edge >= 2 THEN 'up' WHEN net_edge <= -5 THEN 'strong_down' WHEN net_edge <= -2 THEN 'down' ELSE 'balanced' END AS action, CASE WHEN v_above > p_above * 115e-2 AND v_below <= p_below * 115e-2 THEN 'open_above' WHEN v_below > p_below * 115e-2 AND v_above <= p_above * 115e-2 THEN 'open_below' WHEN v_above > p_above * 115e-2 THEN 'thin' ELSE 'firm' END AS regime FROM n")
def regime_totals(spark: SparkSession, d: str) -> DataFrame:
    """Force totals above and below the spot, the net edge, and the action and regime that follow."""
    total = lambda x, side: F.sum(F.when(side, F.col(x)).otherwise(0.0))
    k = F.col("k")
    df = forces(spark, d).groupBy("bin_seq").agg(total("pressure_variant", k > 0).alias("p_above"), total("pressure_variant", k < 0).alias("p_below"), total("vacuum_variant", k > 0).alias("v_above"), total("vacuum_variant", k < 0).alias("v_below"))
    df = df.withColumn("net_edge", (F.col("p_below") - F.col("p_above")) + (F.col("v_above") - F.col("v_below")))
    e, above, below = F.col("net_edge"), F.col("v_above") > F.col("p_above") * 1.15, F.col("v_below") > F.col("p_below") * 1.15
    action = F.when(e >= 5, "strong_up").when(e >= 2, "up").when(e <= -5, "strong_down").when(e <= -2, "down").otherwise("balanced")
    regime = F.when(above & ~below, "open_above").when(below & ~above, "open_below").when(above, "thin").otherwise("firm")
    return shown(df.withColumns({"action": action, "regime": regime}))


@query(f"WITH {S.FORCES}, s AS (SELECT bin_seq, sum(CASE WHEN k > 0 THEN pressure_variant ELSE 0 END) AS pa, sum(CASE WHEN k < 0 THEN pressure_variant ELSE 0 END) AS pb, sum(CASE WHEN k > 0 THEN vacuum_variant ELSE 0 END) AS va, sum(CASE WHEN k < 0 THEN vacuum_variant ELSE 0 END) AS vb FROM forces GROUP BY bin_seq), n AS (SELECT *, (pb + va) - (pa + vb) AS e FROM s) SELECT bin_seq, CASE WHEN e > 5 AND va > pa AND pb > vb THEN 'HOLD' WHEN e > -2 THEN 'TIGHTEN' ELSE 'EXIT' END AS long_action, CASE WHEN e < -5 AND pa > va AND vb > pb THEN 'HOLD' WHEN e < 2 THEN 'TIGHTEN' ELSE 'EXIT' END AS short_action, CASE WHEN vb > greatest(pb * 115e-2, 2) THEN 'SUPPORT FAILING' WHEN va > greatest(pa * 115e-2, 2) THEN 'RESISTANCE THINNING' WHEN e >= 2 THEN 'UP ADVANTAGE' WHEN e <= -2 THEN 'DOWN ADVANTAGE' ELSE 'BALANCED' END AS risk FROM n")
def force_labels(spark: SparkSession, d: str) -> DataFrame:
    """What the force totals advise for longs and shorts, and the risk they show."""
    return X.force_labels(forces(spark, d))


_HIT = "h1 AS (SELECT m.bin_seq, m.signal, lead(mid_price, 1) OVER w - mid_price AS r1, lead(mid_price, 4) OVER w - mid_price AS r4 FROM msd m JOIN bins USING (bin_seq) WINDOW w AS (ORDER BY m.bin_seq))"


@query(f"WITH {S.FORCES}, {_MSD}, {_HIT} SELECT round(avg(CASE WHEN signal <> 0 AND r1 <> 0 THEN CASE WHEN sign(signal) = sign(r1) THEN 1e0 ELSE 0e0 END END), 6) AS hit_1, round(avg(CASE WHEN signal <> 0 AND r4 <> 0 THEN CASE WHEN sign(signal) = sign(r4) THEN 1e0 ELSE 0e0 END END), 6) AS hit_4, count(*) AS n FROM h1")
def sign_hit_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often a signal has the sign of the move one and four bins ahead, where both have one."""
    df = X.compute("msd", forces(spark, d), R).join(market.bins(spark, d).select("bin_seq", "mid_price"), "bin_seq")

    def build(p: DataFrame, axis) -> DataFrame:
        return p.withColumns({f"r{n}": F.lead("mid_price", n).over(axis.ordered) - F.col("mid_price") for n in (1, 4)})

    df = over_chunks(df, [], "bin_seq", 0, build, ahead=4)
    hit = lambda r: F.avg(F.when((F.col("signal") != 0) & (F.col(r) != 0), (F.signum("signal") == F.signum(r)).cast("double")))
    return shown(df.agg(hit("r1").alias("hit_1"), hit("r4").alias("hit_4"), F.count("*").alias("n")))


@query(f"WITH {S.GOLD} SELECT round(avg(CASE WHEN flow_state_code = 1 THEN 1e0 ELSE 0e0 END), 6) AS pressure, round(avg(CASE WHEN flow_state_code = 0 THEN 1e0 ELSE 0e0 END), 6) AS neutral, round(avg(CASE WHEN flow_state_code = -1 THEN 1e0 ELSE 0e0 END), 6) AS vacuum FROM gold")
def state_shares(spark: SparkSession, d: str) -> DataFrame:
    share = lambda s: F.avg((F.col("flow_state_code") == s).cast("double"))
    return shown(G.gold(market.silver(spark, d)).agg(share(1).alias("pressure"), share(0).alias("neutral"), share(-1).alias("vacuum")))


@query(f"WITH {S.FORCES}, {_MSD}, q AS (SELECT bin_seq, signal - lag(signal) OVER (ORDER BY bin_seq) AS d1, lag(signal) OVER (ORDER BY bin_seq) - lag(signal, 2) OVER (ORDER BY bin_seq) AS d0, signal FROM msd), r AS (SELECT median(signal) AS med, mad(signal) AS mad, quantile_cont(abs(d1), 0.95) AS p95, avg(abs(d1)) AS mean_abs_d1, avg(CASE WHEN d0 <> 0 AND d1 <> 0 THEN CASE WHEN sign(d0) <> sign(d1) THEN 1e0 ELSE 0e0 END END) AS flip_rate FROM q) SELECT {S.rnd('med', 'mad', 'p95', 'mean_abs_d1', 'flip_rate')}, (SELECT count(*) FROM q WHERE abs(signal - r.med) > 3 * 1.4826e0 * r.mad) AS n_shifts FROM r")
def regime_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Over a whole signal: median, MAD, the size of steps, how often the slope flips, and bins over three sigmas."""
    df = X.compute("msd", forces(spark, d), R)

    def build(p: DataFrame, axis) -> DataFrame:
        a, b = F.lag("signal", 1).over(axis.ordered), F.lag("signal", 2).over(axis.ordered)
        return p.withColumns({"d1": F.col("signal") - a, "d0": a - b})

    df = over_chunks(df, [], "bin_seq", 2, build)
    flip = F.when((F.col("d0") != 0) & (F.col("d1") != 0), (F.signum("d0") != F.signum("d1")).cast("double"))
    df = files.stored(df, "slopes")
    med = percentiles(df, F.col("signal"), [0.5]).get(None, [None])[0]
    mad = percentiles(df, F.abs(F.col("signal") - (med or 0.0)), [0.5]).get(None, [0.0])[0]
    p95 = percentiles(df, F.abs("d1"), [0.95]).get(None, [None])[0]
    shift = F.abs(F.col("signal") - (med or 0.0)) > 3 * 1.4826 * mad
    one = df.agg(F.avg(F.abs("d1")).alias("mean_abs_d1"), F.avg(flip).alias("flip_rate"), F.count_if(shift).alias("n_shifts"))
    return shown(one.withColumns({"med": F.lit(med).cast("double"), "mad": F.lit(mad), "p95": F.lit(p95).cast("double")}))


# ---- detection and evaluation

_T = ", ".join(f"({t}e0)" for t in THRESHOLDS)
_CROSS = f"""th(threshold) AS (VALUES {_T}),
st AS (SELECT threshold, bin_seq, CASE WHEN signal >= threshold THEN 1 WHEN signal <= -threshold THEN -1 ELSE 0 END AS s FROM iirc, th WHERE bin_seq >= {WARMUP}),
cr AS (SELECT * FROM (SELECT *, coalesce(lag(s) OVER (PARTITION BY threshold ORDER BY bin_seq), 0) AS p FROM st) WHERE s <> 0 AND s <> p),
shots AS (SELECT threshold, min(bin_seq) AS bin_seq FROM cr GROUP BY threshold
          UNION ALL SELECT s.threshold, (SELECT min(c.bin_seq) FROM cr c WHERE c.threshold = s.threshold AND c.bin_seq >= s.bin_seq + {COOLDOWN}) FROM shots s
          WHERE (SELECT min(c.bin_seq) FROM cr c WHERE c.threshold = s.threshold AND c.bin_seq >= s.bin_seq + {COOLDOWN}) IS NOT NULL),
fired AS (SELECT threshold, bin_seq, CASE WHEN s = 1 THEN 'up' ELSE 'down' END AS direction FROM shots JOIN cr USING (threshold, bin_seq))"""
_OUT = f"""en AS (SELECT f.*, b.mid_price AS entry, b.ts_ns AS entry_ns FROM fired f JOIN bins b USING (bin_seq) WHERE b.mid_price > 0),
ht AS (SELECT e.threshold, e.bin_seq, min(p.bin_seq) AS hit FROM en e JOIN bins p ON p.bin_seq > e.bin_seq AND p.bin_seq < e.bin_seq + {HOLD} AND p.mid_price > 0
       AND (CASE WHEN direction = 'up' THEN p.mid_price - entry >= 2 OR p.mid_price - entry <= -1 ELSE p.mid_price - entry <= -2 OR p.mid_price - entry >= 1 END) GROUP BY 1, 2),
ob AS (SELECT e.*, hit, coalesce(hit, least(e.bin_seq + {HOLD}, (SELECT max(bin_seq) + 1 FROM bins)) - 1) AS ob FROM en e LEFT JOIN ht USING (threshold, bin_seq)),
oc AS (SELECT o.threshold, o.bin_seq, direction, entry AS entry_price, (p.mid_price - entry) / 25e-2 * CASE WHEN direction = 'up' THEN 1 ELSE -1 END AS pnl_ticks, hit, p.mid_price AS outcome_price, (p.ts_ns - entry_ns) / 1e6 AS time_to_outcome_ms FROM ob o JOIN bins p ON p.bin_seq = o.ob),
outc AS (SELECT * EXCLUDE (hit), CASE WHEN hit IS NULL THEN 'timeout' WHEN pnl_ticks > 0 THEN 'tp' ELSE 'sl' END AS outcome FROM oc)"""
_SUM = f"""sm AS (SELECT threshold, count(*) AS n_signals, count(*) FILTER (direction = 'up') AS n_up, count(*) FILTER (direction = 'down') AS n_down, avg(CASE WHEN outcome = 'tp' THEN 1e0 ELSE 0e0 END) AS tp_rate, avg(CASE WHEN outcome = 'sl' THEN 1e0 ELSE 0e0 END) AS sl_rate,
       avg(CASE WHEN outcome = 'timeout' THEN 1e0 ELSE 0e0 END) AS timeout_rate, median(time_to_outcome_ms) FILTER (outcome <> 'timeout') AS median_time_to_outcome_ms, avg(pnl_ticks) AS mean_pnl_ticks FROM outc GROUP BY threshold),
swept AS (SELECT threshold, coalesce(n_signals, 0) AS n_signals, coalesce(n_up, 0) AS n_up, coalesce(n_down, 0) AS n_down, tp_rate, sl_rate, timeout_rate, median_time_to_outcome_ms, mean_pnl_ticks, coalesce(n_signals, 0) / ((SELECT max(ts_ns) - min(ts_ns) FROM bins) / 36e11) AS events_per_hour, {COOLDOWN} AS cooldown_bins FROM th LEFT JOIN sm USING (threshold))"""
_BASE = f"WITH RECURSIVE {S.SILVER}, {_IIRC}, {_CROSS}, {_OUT}, {_SUM}"


def _iirc(spark: SparkSession, d: str) -> DataFrame:
    return X.compute("iirc", market.silver(spark, d), R)


def _shots(spark: SparkSession, d: str) -> DataFrame:
    return E.with_cooldown(E.crossings(_iirc(spark, d), THRESHOLDS, WARMUP), COOLDOWN)


@query(f"{_BASE} SELECT threshold, bin_seq, direction FROM fired")
def detected_signals(spark: SparkSession, d: str) -> DataFrame:
    return _shots(spark, d)


@query(f"{_BASE} SELECT threshold, bin_seq, direction, entry_price, outcome, outcome_price, time_to_outcome_ms, pnl_ticks FROM outc")
def trade_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return E.outcomes(_shots(spark, d), market.bins(spark, d), hold=HOLD)


@query(f"{_BASE} SELECT threshold, n_signals, n_up, n_down, {S.rnd('tp_rate', 'sl_rate', 'timeout_rate', 'median_time_to_outcome_ms', 'mean_pnl_ticks', 'events_per_hour')}, cooldown_bins FROM swept")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return shown(E.sweep(_iirc(spark, d), market.bins(spark, d), THRESHOLDS, COOLDOWN, WARMUP, hold=HOLD))


@query(f"WITH {S.LATTICE}, h AS (SELECT e.bin_seq, arg_min(p.mid_price - e.mid_price, p.bin_seq) AS move FROM bins e JOIN bins p ON p.bin_seq > e.bin_seq AND p.bin_seq < e.bin_seq + {HOLD} AND p.mid_price > 0 AND abs(p.mid_price - e.mid_price) >= 1 WHERE e.mid_price > 0 GROUP BY 1) SELECT bin_seq, CAST(coalesce(sign(move), 0) AS INTEGER) AS label FROM bins LEFT JOIN h USING (bin_seq)")
def direction_labels(spark: SparkSession, d: str) -> DataFrame:
    return E.labels(market.bins(spark, d), hold=HOLD)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Run rows of two signals, as a sweep appends them."""
    bins = market.bins(spark, d)
    frames = []
    for name, run in (("iirc", "run-iirc"), ("msd", "run-msd")):
        lattice = market.silver(spark, d) if name == "iirc" else forces(spark, d)
        frames.append(E.sweep(X.compute(name, lattice, R), bins, THRESHOLDS, COOLDOWN, WARMUP, hold=HOLD).withColumn("run_id", F.lit(run)))
    return results.union_rows(*frames)


def _run_sql(name: str) -> str:
    return f"SELECT 'run-{name}' AS run_id, * FROM swept"


_ONE = f"{_BASE}, runs AS ({_run_sql('iirc')})"


def _one_run(spark: SparkSession, d: str) -> DataFrame:
    return E.sweep(_iirc(spark, d), market.bins(spark, d), THRESHOLDS, COOLDOWN, WARMUP, hold=HOLD).withColumn("run_id", F.lit("run-iirc"))


@query(f"{_ONE} SELECT run_id, threshold, n_signals, {S.rnd('tp_rate', 'mean_pnl_ticks')} FROM runs WHERE n_signals >= 5 AND tp_rate IS NOT NULL ORDER BY tp_rate DESC, threshold LIMIT 1")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return shown(results.best_per_run(_one_run(spark, d)), "run_id", "threshold", "n_signals", "tp_rate", "mean_pnl_ticks")


@query(f"{_ONE} SELECT run_id, threshold, {S.rnd('tp_rate')} FROM runs ORDER BY coalesce(tp_rate, '-infinity'::DOUBLE) DESC, threshold LIMIT 1")
def tracked_best(spark: SparkSession, d: str) -> DataFrame:
    return shown(results.tracked_best(_one_run(spark, d)), "run_id", "threshold", "tp_rate")


@query(f"{_ONE} SELECT run_id, threshold, {S.rnd('sl_rate')}, row_number() OVER (ORDER BY sl_rate ASC NULLS LAST, run_id, threshold) AS rank FROM runs ORDER BY rank LIMIT 3")
def ranked_runs(spark: SparkSession, d: str) -> DataFrame:
    return shown(results.ranked(_one_run(spark, d), "sl_rate", 3), "run_id", "threshold", "sl_rate", "rank")


@query(f"{_ONE} SELECT unnest(['rates', 'counts', 'no_rates']) AS rule, unnest([count(*) FILTER (n_signals > 0 AND abs(tp_rate + sl_rate + timeout_rate - 1) > 1e-6), count(*) FILTER (n_up + n_down <> n_signals), count(*) FILTER (n_signals > 0 AND tp_rate IS NULL)]) AS n_bad, count(*) AS n_rows FROM runs")
def rate_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.rate_checks(_one_run(spark, d))


@query(f"{_ONE} SELECT run_id, 'iirc' AS signal_name, 1e-1 AS noise, CAST(NULL AS DOUBLE) AS unknown, threshold, n_signals, {S.rnd('tp_rate', 'mean_pnl_ticks')} FROM runs")
def run_detail(spark: SparkSession, d: str) -> DataFrame:
    """One run with its metadata, parameters and threshold rows."""
    meta = spark.createDataFrame([("run-iirc", "iirc", '{"noise": 0.1}'), ("run-msd", "msd", "{}")], "run_id string, signal_name string, signal_params_json string")
    df = results.detail(_one_run(spark, d), meta, "run-iirc", ["noise", "unknown"])
    return shown(df, "run_id", "signal_name", "noise", "unknown", "threshold", "n_signals", "tp_rate", "mean_pnl_ticks")


def _two_runs() -> str:
    """The rows of both runs: the chain of detection and evaluation once for each signal, under names of its own."""
    def of(name: str) -> str:
        chain = f"{_CROSS}, {_OUT}, {_SUM}".replace("FROM iirc, th", f"FROM {name}, th")
        for cte in ("fired", "shots", "swept", "outc", "th", "st", "cr", "en", "ht", "ob", "oc", "sm"):
            chain = re.sub(rf"\b{cte}\b(?=\(| AS \(|,| |\))(?<!\.)", f"{name}_{cte}", chain)
        return chain

    rows = " UNION ALL ".join(f"SELECT 'run-{name}' AS run_id, '{name}' AS signal_name, {noise} AS noise, * FROM {name}_swept" for name, noise in (("iirc", "1e-1"), ("msd", "0e0")))
    return f"WITH RECURSIVE {S.FORCES}, {_IIRC}, {_MSD}, {of('iirc')}, {of('msd')}, runs AS ({rows})"


@query(f"{_two_runs()}, best AS (SELECT * FROM runs WHERE n_signals >= 5 AND tp_rate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY tp_rate DESC, threshold) = 1) SELECT row_number() OVER (ORDER BY tp_rate DESC NULLS LAST, run_id, threshold) AS rank, run_id, signal_name, threshold, n_signals, {S.rnd('tp_rate')} FROM best")
def run_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Best rows of the runs of two signals, joined with their metadata and ranked by take-profit rate."""
    meta = spark.createDataFrame([("run-iirc", "iirc", '{"noise": 0.1}'), ("run-msd", "msd", '{"noise": 0.0}')], "run_id string, signal_name string, signal_params_json string")
    best = results.best_per_run(_runs(spark, d))
    return shown(results.ranked(results.with_meta(best, meta, ["signal_name", "unknown"]), "tp_rate"), "rank", "run_id", "signal_name", "threshold", "n_signals", "tp_rate")


@query(f"{_two_runs()} SELECT noise AS value, round(avg(tp_rate), 6) AS tp_rate, CAST(sum(n_signals) AS BIGINT) AS n_signals FROM runs GROUP BY noise")
def parameter_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Mean rates by the value of one parameter, read from the JSON of the runs' metadata."""
    meta = spark.createDataFrame([("run-iirc", '{"noise": 0.1}'), ("run-msd", '{"noise": 0.0}')], "run_id string, signal_params_json string")
    return shown(results.sensitivity(_runs(spark, d), meta, "noise"))
