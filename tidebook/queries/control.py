"""Queries behind the control plane (versions, aliases, jobs, steps), set operations, scalars, the feature graph and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions import scalar
from tidebook.functions.quantiles import percentiles
from tidebook.operators import joins, projection, serving
from tidebook.plans import features, sweep
from tidebook.queries import sql as S
from tidebook.queries.registry import query, shown
from tidebook.sources import market

STEPS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def aliases(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a log of aliases: a customer is an alias that every order points anew."""
    o = market.table(spark, d, "orders")
    return o.select(F.concat(F.lit("alias-"), F.col("o_custkey")).alias("alias"), F.concat(F.lit("v-"), F.col("o_orderkey") % 500).alias("serving_id"), F.col("o_orderkey").alias("event_id"))


_LOG = "lg AS (SELECT 'alias-' || o_custkey AS alias, 'v-' || (o_orderkey % 500) AS serving_id, o_orderkey AS event_id FROM orders), cur AS (SELECT alias, arg_max(serving_id, event_id) AS serving_id, max(event_id) AS event_id FROM lg GROUP BY alias)"


@query(f"WITH {_LOG} SELECT alias, serving_id, event_id FROM cur")
def current_aliases(spark: SparkSession, d: str) -> DataFrame:
    return serving.latest(aliases(spark, d), "alias", "event_id")


@query(f"WITH {_LOG} SELECT alias, serving_id, event_id, lag(serving_id) OVER (PARTITION BY alias ORDER BY event_id) AS previous FROM lg")
def alias_history(spark: SparkSession, d: str) -> DataFrame:
    return serving.history(aliases(spark, d), "alias", "event_id").select("alias", "serving_id", "event_id", "previous")


@query("WITH v AS (SELECT DISTINCT 'v-' || (o_orderkey % 500) AS serving_id FROM orders), al AS (SELECT 'alias-' || o_custkey AS alias, arg_max('v-' || (o_orderkey % 500), o_orderkey) AS serving_id FROM orders GROUP BY 1) SELECT serving_id, coalesce((SELECT string_agg(alias, ',' ORDER BY alias) FROM al WHERE al.serving_id = v.serving_id), '') AS aliases FROM v")
def version_list(spark: SparkSession, d: str) -> DataFrame:
    log = aliases(spark, d)
    df = serving.version_list(log.select("serving_id").distinct(), serving.latest(log, "alias", "event_id"))
    return df.select("serving_id", F.array_join("aliases", ",").alias("aliases"))


@query(f"WITH {_LOG}, nm AS (SELECT DISTINCT 'alias-' || c_custkey AS name FROM customer UNION SELECT DISTINCT 'v-' || c_custkey FROM customer) SELECT name, coalesce(cur.serving_id, (SELECT min(serving_id) FROM lg WHERE lg.serving_id = name)) AS serving_id FROM nm LEFT JOIN cur ON cur.alias = name")
def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    log, c = aliases(spark, d), market.table(spark, d, "customer")
    names = c.select(F.concat(F.lit("alias-"), F.col("c_custkey")).alias("name")).union(c.select(F.concat(F.lit("v-"), F.col("c_custkey")).alias("name"))).distinct()
    return serving.resolve(names, serving.latest(log, "alias", "event_id"), log.select("serving_id").distinct())


@query(f"WITH {_LOG} SELECT alias, serving_id, event_id FROM cur WHERE CAST(substr(serving_id, 3) AS INTEGER) % 50 = 7 ORDER BY event_id DESC, alias LIMIT 1")
def alias_of_run(spark: SparkSession, d: str) -> DataFrame:
    """The latest alias of a run; every version belongs to one of 50 runs."""
    log = aliases(spark, d)
    versions = log.select("serving_id").distinct().withColumn("run_id", F.substring("serving_id", 3, 9).cast("int") % 50)
    return serving.alias_of_run(serving.latest(log, "alias", "event_id"), versions, 7, "event_id").select("alias", "serving_id", "event_id")


@query("SELECT event_id, user_id AS workspace_id, event_type AS action, epoch_us(ts) AS created_us FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_page(spark: SparkSession, d: str) -> DataFrame:
    """The newest audit events of one workspace."""
    log = market.table(spark, d, "events").select("event_id", F.col("user_id").alias("workspace_id"), F.col("event_type").alias("action"), market.micros("ts").alias("created_us"))
    return serving.recent(log, "workspace_id", 7, ["created_us", "event_id"])


@query("WITH o AS (SELECT o_custkey AS run_id, o_orderpriority AS config_hash FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY ALL), n AS (SELECT DISTINCT o_custkey AS run_id, o_orderpriority AS config_hash FROM orders WHERE o_orderdate >= DATE '1998-01-01') SELECT run_id, config_hash FROM o UNION ALL SELECT run_id, config_hash FROM n ANTI JOIN o USING (run_id, config_hash)")
def promoted_versions(spark: SparkSession, d: str) -> DataFrame:
    o = market.table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("config_hash"), "o_orderdate")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("date")
    return serving.promote(o.filter(early).select("run_id", "config_hash").distinct(), o.filter(~early).select("run_id", "config_hash"))


@query("WITH l AS (SELECT o_custkey, count(*) % 7 AS m FROM orders GROUP BY 1 HAVING o_custkey % 2 = 0) SELECT o_custkey, o_orderkey, coalesce(m, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sequence FROM orders LEFT JOIN l USING (o_custkey)")
def sequenced_events(spark: SparkSession, d: str) -> DataFrame:
    """Events numbered on from the last number of their job."""
    o = market.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    last = o.filter("o_custkey % 2 = 0").groupBy("o_custkey").agg((F.count("*") % 7).alias("max_sequence"))
    return serving.numbered(o, "o_custkey", "o_orderkey", last).select("o_custkey", "o_orderkey", "sequence")


@query("WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sequence FROM orders) SELECT o_custkey, o_orderkey, sequence FROM n WHERE sequence > CASE WHEN o_custkey % 3 = 0 THEN 4 ELSE 0 END")
def events_after(spark: SparkSession, d: str) -> DataFrame:
    """The tail of each job's events behind the last one seen."""
    o = market.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    n = serving.numbered(o, "o_custkey", "o_orderkey", o.select("o_custkey", F.lit(0).alias("max_sequence")).distinct())
    seen = o.filter("o_custkey % 3 = 0").select("o_custkey", F.lit(4).alias("seen")).distinct()
    return serving.after(n, "o_custkey", seen).select("o_custkey", "o_orderkey", "sequence")


_STEPS = f"stp(step, i) AS (VALUES {', '.join(f"('{s}', {i})" for i, s in enumerate(STEPS))})"


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    o = market.table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("session"), F.col("o_orderpriority").alias("step"), F.when(F.col("o_orderstatus") == "F", "committed").otherwise("draft").alias("status"))


@query(f"WITH {_STEPS}, se AS (SELECT DISTINCT o_custkey AS session FROM orders), lf AS (SELECT session, step, i FROM se, stp WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = session AND o_orderpriority = step AND o_orderstatus = 'F')) SELECT session, step, i = min(i) OVER (PARTITION BY session) AS ready FROM lf")
def open_steps(spark: SparkSession, d: str) -> DataFrame:
    return serving.open_steps(_sessions(spark, d), STEPS)


@query(f"WITH {_STEPS} SELECT o_custkey AS session, step, i AS step_index, count(*) AS n FROM orders JOIN stp ON step = o_orderpriority WHERE o_orderstatus = 'F' GROUP BY ALL")
def decision_log(spark: SparkSession, d: str) -> DataFrame:
    return serving.decision_log(_sessions(spark, d), STEPS).groupBy("session", "step", "step_index").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS role, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL GROUP BY 1")
def unknown_roles(spark: SparkSession, d: str) -> DataFrame:
    fields = market.table(spark, d, "orders").select(F.col("o_orderpriority").alias("role"))
    return serving.unknown_roles(fields, ["1-URGENT", "2-HIGH"]).groupBy("role").agg(F.count("*").alias("n"))


@query("(SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def nations_in_use(spark: SparkSession, d: str) -> DataFrame:
    """Union, difference and distinct over key sets."""
    t = lambda name: market.table(spark, d, name)
    used = t("customer").select(F.col("c_nationkey").alias("nation")).union(t("supplier").select("s_nationkey"))
    return used.distinct().subtract(t("nation").filter("n_regionkey = 1").select("n_nationkey"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def shared_nations(spark: SparkSession, d: str) -> DataFrame:
    return market.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(market.table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT DISTINCT o_orderpriority AS value, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS slug, sha256(o_orderpriority || '|x=1') AS hash FROM orders")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    v = market.table(spark, d, "orders").select(F.col("o_orderpriority").alias("value")).distinct().orderBy("value")
    return v.select("value", scalar.slug(F.col("value")).alias("slug"), F.sha2(F.concat("value", F.lit("|x=1")), 256).alias("hash"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, epoch_us((CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' 09:30:00')::TIMESTAMP AT TIME ZONE 'America/New_York') * 1000 AS open_ns, dayofweek(o_orderdate) = 5 AND day(o_orderdate) BETWEEN 15 AND 21 AS third_friday, CAST(o_orderdate AS DATE) = last_day(o_orderdate) - CASE dayofweek(last_day(o_orderdate)) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS last_business_day, dayofweek(o_orderdate) = 5 AND day(o_orderdate) BETWEEN 15 AND 21 AND month(o_orderdate) % 3 = 0 AS quarterly FROM orders")
def trading_days(spark: SparkSession, d: str) -> DataFrame:
    """Opening times in UTC with daylight saving, and the days of the contract calendar."""
    day = market.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    c = F.col("day")
    return day.select(c.cast("string").alias("day"), scalar.wall_clock_ns(c, F.lit("09:30:00")).alias("open_ns"), scalar.is_third_friday(c).alias("third_friday"), scalar.is_last_business_day(c).alias("last_business_day"), scalar.is_quarterly(c).alias("quarterly"))


@query(f"WITH {S.LATTICE}, x AS (SELECT bin_seq, mid_price, 1 - exp(-(mid_price / 10) / 2) AS alpha, greatest(-1e0, least(1e0, mid_price / 50)) AS clipped, CASE WHEN mid_price <= 10 THEN 1e0 WHEN mid_price <= 40 THEN 1 + (mid_price - 10) * (2 / 30e0) ELSE 3e0 END AS spread FROM bins) SELECT bin_seq, round(CASE WHEN mid_price <= 0 THEN 0 WHEN mid_price / 10 / 2 > 50 THEN 1 ELSE alpha END, 6) AS alpha, round(clipped, 6) AS clipped, round(spread, 6) AS spread FROM x")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("mid_price")
    df = market.bins(spark, d).select("bin_seq", scalar.decay_alpha(m / 10, 2.0).alias("alpha"), scalar.unit_interval(m / 50).alias("clipped"), scalar.piecewise(m, [(10, 1), (40, 3)]).alias("spread"))
    return shown(df)


@query(f"""WITH {S.LATTICE}, full_bins AS (SELECT bin_seq, mid_price FROM bins WHERE bin_event_count > 0)
SELECT b.bin_seq, round(l.mid_price + (r.mid_price - l.mid_price) * (b.bin_seq + 5e-1 - l.bin_seq) / (r.bin_seq - l.bin_seq), 6) AS half_past
FROM bins b ASOF LEFT JOIN full_bins l ON b.bin_seq >= l.bin_seq ASOF LEFT JOIN full_bins r ON b.bin_seq < r.bin_seq""")
def sampled_history(spark: SparkSession, d: str) -> DataFrame:
    """The mid price at half past of every bin, on the line between the neighbouring bins that have events."""
    bins = market.bins(spark, d)
    known = bins.filter("bin_event_count > 0").select((2 * F.col("bin_seq")).alias("at"), "mid_price")
    asked = bins.select("bin_seq", (2 * F.col("bin_seq") + 1).alias("half"))
    return shown(joins.interpolated(asked, known, [], "half", "at", ["mid_price"], 8192).select("bin_seq", F.col("mid_price_at").alias("half_past")))


@query(f"""WITH {S.LATTICE}, s AS (SELECT bin_seq, 4 * mid_price AS spot, (best_bid + best_ask - 200 * mid_price) / (best_ask - best_bid + 1) AS signal FROM bins WHERE bin_event_count > 0),
h AS (SELECT * FROM (VALUES (1, 6e0, 5e-1), (2, 10e0, 4e-1), (3, 13e0, 35e-2), (4, 16e0, 3e-1)) AS v(horizon, spread, alpha)), c AS (SELECT bin_seq, horizon, spot - signal * spread AS centre, alpha FROM s CROSS JOIN h)
SELECT bin_seq, CAST(horizon AS INTEGER) AS horizon, round(centre, 6) AS centre, round(centre - 4, 6) AS low, round(centre + 4, 6) AS high, round(alpha, 6) AS alpha FROM c""")
def projected_rows(spark: SparkSession, d: str) -> DataFrame:
    """Places of the spot one to four bins ahead, by the skew of a bin's values between its best prices."""
    mid = F.col("mid_price")
    skew = (F.col("best_bid") + F.col("best_ask") - 200 * mid) / (F.col("best_ask") - F.col("best_bid") + 1)
    rows = market.bins(spark, d).filter("bin_event_count > 0").select("bin_seq", (4 * mid).alias("spot"), skew.alias("signal"))
    return shown(projection.projected(rows, "spot", "signal"), "bin_seq", "horizon", "centre", "low", "high", "alpha")


# ---- the feature graph

SPEC = {
    "version": 1,
    "nodes": {
        "add": {"type": "silver_ref", "field": "v_add"}, "pull": {"type": "silver_ref", "field": "v_pull"}, "idle": {"type": "silver_ref", "field": "v_fill"},
        "net": {"type": "arithmetic", "op": "sub", "left": "add", "right": "pull"}, "ratio": {"type": "arithmetic", "op": "div", "left": "add", "right": "pull"}, "gap": {"type": "arithmetic", "op": "abs_diff", "left": "add", "right": "pull"},
        "slow": {"type": "temporal_window", "source": "net", "window_bins": 8, "agg": "mean"}, "smooth": {"type": "temporal_window", "source": "net", "window_bins": 8, "agg": "ewm", "alpha": 0.3},
        "near": {"type": "spatial_neighborhood", "source": "slow", "radius": 2, "agg": "mean"}, "z": {"type": "norm", "source": "near", "method": "zscore", "window_bins": 20},
        "unit": {"type": "norm", "source": "gap", "method": "minmax"}, "log": {"type": "norm", "source": "ratio", "method": "log1p"}, "bounded": {"type": "norm", "source": "smooth", "method": "tanh"},
        **{n: {"type": "output", "source": s, "name": n.removeprefix("o_")} for n, s in (("o_z", "z"), ("o_unit", "unit"), ("o_log", "log"), ("o_bounded", "bounded"))},
    },
}

_GRAPH = f"""g1 AS (SELECT bin_seq, k, v_add - v_pull AS net, v_add / (v_pull + 1e-12) AS ratio, abs(v_add - v_pull) AS gap FROM silver WHERE bin_seq < 100),
g2 AS (SELECT *, avg(net) OVER (PARTITION BY k ORDER BY bin_seq ROWS 7 PRECEDING) AS slow, {S.ema('net', '3e-1', 'k')} AS smooth FROM g1),
g3 AS (SELECT *, avg(slow) OVER (PARTITION BY bin_seq ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM g2),
graph AS (SELECT bin_seq, k, (near - avg(near) OVER w) / (stddev_samp(near) OVER w + 1e-12) AS z, CASE WHEN max(gap) OVER () - min(gap) OVER () >= 1e-12 THEN (gap - min(gap) OVER ()) / (max(gap) OVER () - min(gap) OVER ()) ELSE 0 END AS unit, ln(1 + abs(ratio)) AS log, tanh(smooth) AS bounded FROM g3 WINDOW w AS (PARTITION BY k ORDER BY bin_seq ROWS 19 PRECEDING))"""


@query(f"WITH {S.SILVER}, {_GRAPH} SELECT bin_seq, k, {S.rnd('z', 'unit', 'log', 'bounded')} FROM graph")
def feature_graph(spark: SparkSession, d: str) -> DataFrame:
    """A feature graph over the first hundred bins, as a preview asks for."""
    return shown(features.evaluate(market.silver(spark, d), SPEC, first_bins=100))


@query(f"WITH {S.SILVER}, {_GRAPH.replace(' WHERE bin_seq < 100', '')} SELECT bin_seq, k, {S.rnd('z', 'unit', 'log', 'bounded')} FROM graph")
def feature_graph_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same graph over all bins."""
    return shown(features.evaluate(market.silver(spark, d), SPEC))


@query(f"WITH {S.SILVER}, {_GRAPH} " + " UNION ALL ".join(f"SELECT '{o}' AS output, round(avg({o}), 6) AS mean, round(stddev_samp({o}), 6) AS std, round(quantile_cont({o}, 0.25), 6) AS q25, round(quantile_cont({o}, 0.5), 6) AS q50, round(quantile_cont({o}, 0.75), 6) AS q75, count({o}) AS n_valid, count(*) - count({o}) AS n_nan FROM graph" for o in ("z", "unit", "log", "bounded")))
def feature_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return shown(features.stats(features.evaluate(market.silver(spark, d), SPEC, first_bins=100)))


@query("SELECT signal, tp, sl FROM (VALUES ('ads'), ('msd'), ('iirc')) s(signal), (VALUES (4), (8)) t(tp), (VALUES (2), (4)) l(sl)")
def sweep_runs(spark: SparkSession, d: str) -> DataFrame:
    return sweep.table(spark, {"signal": ["ads", "msd", "iirc"], "tp": [4, 8], "sl": [2, 4]}).select("signal", "tp", "sl")


@query("WITH m AS (SELECT event_id, value FROM events) SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most, min(value) AS least, count(*) AS n FROM m")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    events = market.table(spark, d, "events")
    found = percentiles(events, F.col("value"), (0.5, 0.95, 0.99)).get(None, [None] * 3)
    e = events.agg(F.max("value").alias("most"), F.min("value").alias("least"), F.count("*").alias("n"))
    return shown(e.withColumns({n: F.lit(p).cast("double") for n, p in zip(("p50", "p95", "p99"), found, strict=True)}))


@query(f"WITH {S.LATTICE} SELECT count(*) AS n_bins, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, min(mid_price) FILTER (mid_price > 0) AS low, max(mid_price) AS high, round(avg(mid_price), 6) AS mean, round(stddev_samp(mid_price), 6) AS std FROM bins")
def dataset_preview(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("mid_price")
    return shown(market.bins(spark, d).agg(F.count("*").alias("n_bins"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.min(F.when(m > 0, m)).alias("low"), F.max(m).alias("high"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("std")))
