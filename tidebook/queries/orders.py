"""Queries over order lifecycles: book, depth, best prices, mechanics, scans and joins in time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.scalar import tick
from tidebook.operators import book, checkpoint, fold, joins, levels, quality
from tidebook.queries import sql as S
from tidebook.queries.registry import query, shown
from tidebook.sources import files, market, mbo
from tidebook.streaming.book import replayed

DAY_US = 86_400_000_000
MONTH = 30 * DAY_US

_BIN = f"first AS (SELECT min(us) AS t0 FROM oe), dl AS (SELECT (us - t0) // {MONTH} AS bin_seq, side, tick, d FROM delta, first)"
_DEPTH = f"""{_BIN}, tk AS (SELECT DISTINCT side, tick FROM dl), bn AS (SELECT unnest(range((SELECT min(bin_seq) FROM dl), (SELECT max(bin_seq) FROM dl) + 1)) AS bin_seq),
pb AS (SELECT b.bin_seq, t.side, t.tick, coalesce(sum(d), 0) AS d FROM bn b CROSS JOIN tk t LEFT JOIN dl ON dl.bin_seq = b.bin_seq AND dl.side = t.side AND dl.tick = t.tick GROUP BY 1, 2, 3),
dp AS (SELECT bin_seq, side, tick, CAST(sum(d) OVER (PARTITION BY side, tick ORDER BY bin_seq) AS BIGINT) AS depth FROM pb),
bb AS (SELECT bin_seq, max(tick) FILTER (side = 'B' AND depth > 0) AS best_bid, min(tick) FILTER (side = 'A' AND depth > 0) AS best_ask, CAST(coalesce(sum(depth) FILTER (side = 'B' AND depth > 0), 0) AS BIGINT) AS bid_depth, CAST(coalesce(sum(depth) FILTER (side = 'A' AND depth > 0), 0) AS BIGINT) AS ask_depth, count(*) FILTER (depth < 0) AS n_negative FROM dp GROUP BY bin_seq),
bs AS (SELECT *, CAST(floor((best_bid + best_ask) / 2e0 + 5e-1) AS BIGINT) AS spot FROM bb)"""


def numbered(spark: SparkSession, d: str) -> DataFrame:
    """Order events with ``seq`` by time, additions first.

    A row's number in a total order would take one task; nothing here needs more than the order of an order's own
    two rows and of rows in a bin, so time and step make the number.
    """
    return market.order_events(spark, d).withColumn("seq", F.floor(F.col("ts_ns") / 1000) * 2 + F.col("step"))


def changed(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Changes of the book with their bin, stored since depth and best prices read them several times, and the first time.

    Order events have no clears, and all of an order are of one line, by which equal lines were numbered. So nothing is
    shuffled after that.
    """
    return in_bins(files.stored(book.changes(numbered(spark, d), few=[], within=["order_key", "order_row"]), "book-changes"))


def in_bins(c: DataFrame) -> tuple[DataFrame, int]:
    """Stored changes with their bin, and the first time, from which bins count."""
    t0 = c.agg(F.min("ts_ns")).first()[0] or 0
    return c.withColumn("bin_seq", F.expr(f"(ts_ns - {t0}) div {MONTH * 1000}")), t0


@query(f"WITH {S.ORDERS}, {_DEPTH} SELECT bin_seq, side, tick, depth FROM dp")
def book_depth(spark: SparkSession, d: str) -> DataFrame:
    c, _ = changed(spark, d)
    return book.depth(c, c.select("bin_seq")).select("bin_seq", "side", "tick", "depth")


def best(c: DataFrame) -> DataFrame:
    first, last = c.agg(F.min("bin_seq"), F.max("bin_seq")).first()
    return levels.best_prices(files.stored(levels.intervals(c), "book-intervals"), *((0, -1) if first is None else (first, last)))


_BEST = f"WITH {S.ORDERS}, {_DEPTH} SELECT bin_seq, best_bid, best_ask, bid_depth, ask_depth, n_negative, spot FROM bs"


@query(_BEST)
def book_best_prices(spark: SparkSession, d: str) -> DataFrame:
    c, _ = changed(spark, d)
    return best(c)


@query(f"WITH {S.ORDERS}, {_DEPTH}, gr AS (SELECT bin_seq, spot, unnest(range(-5, 6)) AS k FROM bs WHERE spot IS NOT NULL) SELECT g.bin_seq, CAST(g.k AS INTEGER) AS k, CAST(coalesce(sum(depth) FILTER (side = 'B'), 0) AS BIGINT) AS bid_depth, CAST(coalesce(sum(depth) FILTER (side = 'A'), 0) AS BIGINT) AS ask_depth FROM gr g LEFT JOIN dp ON dp.bin_seq = g.bin_seq AND dp.tick = g.spot + g.k GROUP BY g.bin_seq, g.k")
def depth_around_spot(spark: SparkSession, d: str) -> DataFrame:
    c, _ = changed(spark, d)
    return levels.around_spot(c, best(c), 5)


@query(_BEST)
def restored_best_prices(spark: SparkSession, d: str) -> DataFrame:
    """Best prices of a replay that stopped half way and was restored from the checkpoint that it left."""
    events = files.stored(numbered(spark, d).select(*checkpoint.COLUMNS), "order-events")
    half = (events.agg((F.min("seq") + F.max("seq")) / 2).first()[0]) or 0
    before, path = events.filter(F.col("seq") <= int(half)), f"{files.scratch(spark)}/book-{uuid.uuid4().hex}"
    moved = checkpoint.advance(before, path, "orders", "all")[1]
    after = checkpoint.changes(events, checkpoint.load(spark, path, "orders", "all"))
    return best(in_bins(files.stored(moved.unionByName(after), "book-changes"))[0])


@query(_BEST)
def stream_best_prices(spark: SparkSession, d: str) -> DataFrame:
    """Best prices of a stream of order events that comes in three pieces and is stopped after each."""
    events, path = files.stored(numbered(spark, d).select(*checkpoint.COLUMNS), "order-events"), f"{files.scratch(spark)}/book-{uuid.uuid4().hex}"
    first, last = events.agg(F.min("seq"), F.max("seq")).first()
    first, last = first or 0, last or 0
    cuts = [first - 1 + (last - first + 1) * i // 3 for i in range(4)]
    found = None
    for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        events.filter((F.col("seq") > a) & (F.col("seq") <= z)).write.parquet(f"{path}/in/{i}")
        source = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(f"{path}/in")
        found = replayed(source, spark, f"{path}/out", "orders", "all")
    return best(in_bins(found)[0])


_ANCHORS = """sq AS (SELECT us * 2 + step AS seq, coalesce(sum(d) FILTER (side = 'B'), 0) AS b, coalesce(sum(d) FILTER (side = 'A'), 0) AS a, count(*) AS n FROM delta GROUP BY 1),
rn AS (SELECT seq, sum(b) OVER w AS b, sum(a) OVER w AS a, sum(n) OVER w AS n FROM sq WINDOW w AS (ORDER BY seq)),
ct AS (SELECT 'first' AS kind, min(seq) AS seq FROM rn WHERE b > 0 AND a > 0 UNION ALL SELECT 'again', min(seq) FROM rn WHERE b > 0 AND a > 0 AND n >= 1000),
bb AS (SELECT kind, seq, max(tick) FILTER (side = 'B') AS best_bid, min(tick) FILTER (side = 'A') AS best_ask FROM (SELECT kind, seq, side, tick FROM ct JOIN delta ON us * 2 + step <= seq GROUP BY 1, 2, 3, 4 HAVING sum(d) > 0) GROUP BY 1, 2)"""


@query(f"WITH {S.ORDERS}, {_ANCHORS} SELECT kind, seq, best_bid, best_ask, (best_bid + best_ask + 1) // 2 AS anchor FROM bb")
def book_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The anchor of the first two-sided book, and that of the one-time re-anchor after 1,000 changes."""
    c, _ = changed(spark, d)
    found = {kind: book.anchor(c, after, chunk=2 * MONTH) for kind, after in (("first", 0), ("again", 1000))}
    rows = [(kind, *[x[n] for n in ("seq", "best_bid", "best_ask", "anchor")]) for kind, x in found.items() if x]
    return spark.createDataFrame(rows, "kind string, seq bigint, best_bid int, best_ask int, anchor int")


@query(f"""WITH {S.ORDERS}, {_BIN}, an AS (SELECT tick AS anchor FROM oe ORDER BY us * 2 + step, tick LIMIT 1), cl AS (SELECT bin_seq, side, tick - anchor + 20 AS cell, d FROM dl, an),
bn AS (SELECT unnest(range((SELECT min(bin_seq) FROM dl), (SELECT max(bin_seq) FROM dl) + 1)) AS bin_seq), gr AS (SELECT bin_seq, side, cell FROM bn CROSS JOIN (SELECT unnest(['A', 'B']) AS side) CROSS JOIN (SELECT unnest(range(41)) AS cell)),
pb AS (SELECT g.bin_seq, g.side, g.cell, coalesce(sum(d), 0) AS d FROM gr g LEFT JOIN cl ON cl.bin_seq = g.bin_seq AND cl.side = g.side AND cl.cell = g.cell GROUP BY 1, 2, 3)
SELECT bin_seq, side, CAST(cell AS INTEGER) AS cell, CAST(sum(d) OVER (PARTITION BY side, cell ORDER BY bin_seq) AS BIGINT) AS depth FROM pb""")
def core_grid(spark: SparkSession, d: str) -> DataFrame:
    """Depth on a full grid of 41 ticks around the first price."""
    c, _ = changed(spark, d)
    at = book.first_price(numbered(spark, d))
    return book.full_grid(c, c.select("bin_seq"), 0 if at is None else at, 20)


@query(f"WITH {S.ORDERS}, r AS (SELECT order_id, side, tick, sum(CASE WHEN step = 0 THEN size WHEN action = 'F' THEN -size ELSE -1000000000 END) AS q FROM oe GROUP BY 1, 2, 3) SELECT side, tick, count(*) AS n_orders, CAST(sum(q) AS BIGINT) AS qty FROM r WHERE q > 0 GROUP BY side, tick")
def resting_orders(spark: SparkSession, d: str) -> DataFrame:
    return book.resting(files.stored(numbered(spark, d), "order-events")).groupBy("side", "tick").agg(F.count("*").alias("n_orders"), F.sum("qty").alias("qty"))


@query(f"WITH {S.ORDERS}, {_BIN}, e AS (SELECT (us - t0) // {MONTH} AS bin_seq, action, size, order_id FROM oe, first) SELECT bin_seq, action, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM e GROUP BY bin_seq, action")
def events_per_bin(spark: SparkSession, d: str) -> DataFrame:
    events = market.order_events(spark, d)
    t0 = events.agg(F.min("ts_ns")).first()[0] or 0
    return events.groupBy(F.expr(f"(ts_ns - {t0}) div {MONTH * 1000}").alias("bin_seq"), "action").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def _mechanics_sql() -> str:
    """The fold as a recursion over the rows of a tick; events of one time are one row, whose first event the chains see."""
    rates = ("add", "pull", "fill", "bid", "ask")
    order = "ORDER BY step, d_add, d_pull, d_fill, d_bid, d_ask"
    delta = {"add": "CASE WHEN action = 'A' THEN d ELSE 0 END", "pull": "CASE WHEN action = 'C' THEN -d ELSE 0 END", "fill": "CASE WHEN action = 'F' THEN -d ELSE 0 END", "bid": "CASE WHEN side = 'B' THEN d ELSE 0 END", "ask": "CASE WHEN side = 'A' THEN d ELSE 0 END"}
    alpha = lambda tau: f"CASE WHEN dt / {tau}e0 > 50 THEN 1e0 ELSE 1e0 - exp(-dt / {tau}e0) END"
    rate = lambda x: f"CASE WHEN kind = 1 THEN d_{x} / dt ELSE 0e0 END"
    return f"""WITH RECURSIVE {S.ORDERS}, first AS (SELECT min(us) AS t0 FROM oe),
mv AS (SELECT tick, (us - t0) // {MONTH} AS bin_seq, (us - t0) * 1000 // 43200 + 1 AS ts, step, {", ".join(f"CAST({delta[x]} AS DOUBLE) AS d_{x}" for x in rates)} FROM delta, first),
g AS (SELECT tick, bin_seq, ts, 1 AS kind, {", ".join(f"sum(d_{x}) AS s_{x}" for x in rates)}, {", ".join(f"first(d_{x} {order}) AS d_{x}" for x in rates)} FROM mv GROUP BY tick, bin_seq, ts),
be AS (SELECT tick, unnest(range(min(bin_seq), (SELECT max(bin_seq) + 1 FROM mv))) AS bin_seq FROM mv GROUP BY tick),
r AS (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY bin_seq, kind DESC, ts) AS n FROM (SELECT * FROM g UNION ALL SELECT tick, bin_seq, (bin_seq + 1) * 60000000000 + 1, 0, {", ".join(["0e0"] * 10)} FROM be)),
st AS (SELECT tick, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS bin_seq, 1 AS kind, CAST(NULL AS BIGINT) AS clock, {", ".join(f"0e0 AS m_{x}" for x in rates[:3])}, {", ".join(f"0e0 AS {c}_{x}" for x in rates for c in "vaj")} FROM (SELECT DISTINCT tick FROM r)
UNION ALL SELECT tick, n, bin_seq, kind, CASE WHEN kind = 1 THEN ts ELSE greatest(clock, ts) END, {", ".join(f"m_{x} * exp(-dt / 30e0) + s_{x}" for x in rates[:3])},
  {", ".join(f"v2_{x}, a2_{x}, CASE WHEN dt > 0 THEN aj * (a2_{x} - a_{x}) / dt + (1e0 - aj) * j_{x} ELSE j_{x} END" for x in rates)}
  FROM (SELECT *, {", ".join(f"CASE WHEN dt > 0 THEN aa * (v2_{x} - v_{x}) / dt + (1e0 - aa) * a_{x} ELSE a_{x} END AS a2_{x}" for x in rates)}
  FROM (SELECT *, {", ".join(f"CASE WHEN dt > 0 THEN av * ({rate(x)}) + (1e0 - av) * v_{x} ELSE v_{x} END AS v2_{x}" for x in rates)}
  FROM (SELECT *, {alpha(2)} AS av, {alpha(5)} AS aa, {alpha(10)} AS aj
  FROM (SELECT r.*, s.clock, {", ".join(f"s.m_{x}" for x in rates[:3])}, {", ".join(f"s.{c}_{x}" for x in rates for c in "vaj")}, CASE WHEN r.ts > s.clock THEN (r.ts - s.clock) / 1e9 ELSE 0e0 END AS dt FROM st s JOIN r ON r.tick = s.tick AND r.n = s.n + 1))))),
dp AS (SELECT tick, bin_seq, sum(b) OVER w AS bid_depth, sum(a) OVER w AS ask_depth FROM (SELECT be.tick, be.bin_seq, coalesce(sum(d_bid), 0) AS b, coalesce(sum(d_ask), 0) AS a FROM be LEFT JOIN mv USING (tick, bin_seq) GROUP BY 1, 2) WINDOW w AS (PARTITION BY tick ORDER BY bin_seq))
SELECT bin_seq, tick, CAST(bid_depth AS BIGINT) AS bid_depth, CAST(ask_depth AS BIGINT) AS ask_depth, {", ".join(f"round(m_{x}, 6) + 0e0 AS {x}_mass" for x in rates[:3])}, {S.rnd("v_add", "v_pull", "v_fill")}, round(v_bid + v_ask, 6) + 0e0 AS v_rest_depth, {S.rnd("a_add", "a_pull", "j_add", "j_pull")}
FROM st JOIN dp USING (tick, bin_seq) WHERE kind = 0"""


@query(_mechanics_sql())
def tick_mechanics(spark: SparkSession, d: str) -> DataFrame:
    """Masses and derivative chains of every tick at every bin end; a bin of 30 days counts as 60 seconds."""
    c, t0 = changed(spark, d)
    scaled = c.withColumn("ts_ns", ((F.col("ts_ns") - t0) / (MONTH * 1000 / 60e9)).cast("long") + 1)
    n = (c.agg(F.max("bin_seq")).first()[0] or 0) + 1
    df = fold.mechanics(scaled, n, 60_000_000_000, 1)
    return shown(df, "bin_seq", "tick", "bid_depth", "ask_depth", "add_mass", "pull_mass", "fill_mass", "v_add", "v_pull", "v_fill", "v_rest_depth", "a_add", "a_pull", "j_add", "j_pull")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN t BETWEEN 0 AND 63 THEN t END AS tick, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 1e3 + 5e-1) AS BIGINT) - 40 + 32 AS t FROM lineitem) GROUP BY 1, 2, 3")
def price_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Prices as ticks of 1000 around tick 40 in a grid of 64; null outside."""
    df = market.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tick(F.col("l_extendedprice"), 1000.0, 40, 64).alias("tick"))
    return df.groupBy("l_orderkey", "l_linenumber", "tick").agg(F.count("*").alias("n"))


_REC = f"""rec AS (SELECT row_number() OVER () AS rid, CASE WHEN event_id % 13 = 0 THEN 18 ELSE 160 END AS rtype, user_id % 7 AS instrument_id, epoch_us(ts) AS us, CASE event_type WHEN 'error' THEN 'C' WHEN 'purchase' THEN 'F' WHEN 'signup' THEN 'M' ELSE 'A' END AS action,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS price, event_id FROM events),
sym(instrument_id, raw_symbol) AS (VALUES (0, 'MNQH6'), (1, 'MNQM6'), (2, 'MNQH6-MNQM6'), (3, 'ESH6'), (4, 'MNQZ6'))"""


@query(f"WITH {_REC} SELECT event_id, CASE WHEN price IS NULL THEN 0 ELSE price END AS price_int, action FROM rec LEFT JOIN sym USING (instrument_id) WHERE rtype = 160 AND (raw_symbol IS NULL OR (starts_with(raw_symbol, 'MNQ') AND NOT contains(raw_symbol, '-'))) AND us >= epoch_us(TIMESTAMP '2024-01-03') AND us < epoch_us(TIMESTAMP '2024-01-04') AND NOT (price IS NULL AND action IN ('A', 'M')) AND us >= epoch_us(TIMESTAMP '2024-01-03 06:00:00')")
def event_scan(spark: SparkSession, d: str) -> DataFrame:
    """Raw records through the filters of a scan: type, symbol, session, null prices, fast-forward."""
    e = market.table(spark, d, "events")
    action = F.when(F.col("event_type") == "error", "C").when(F.col("event_type") == "purchase", "F").when(F.col("event_type") == "signup", "M").otherwise("A")
    rec = e.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 13 == 0, 18).otherwise(160).alias("rtype"), (F.col("user_id") % 7).alias("instrument_id"), (market.micros("ts") * 1000).alias("ts_ns"), action.alias("action"), F.lit("B").alias("side"),
        F.when(F.col("event_id") % 17 != 0, F.round(F.col("value") * 100).cast("long")).alias("price_int"), F.lit(1).cast("long").alias("size"), F.col("event_id").alias("order_id"), F.lit(0).alias("flags"),
    )
    symbols = spark.createDataFrame([(0, "MNQH6"), (1, "MNQM6"), (2, "MNQH6-MNQM6"), (3, "ESH6"), (4, "MNQZ6")], "instrument_id long, raw_symbol string")
    skip = 1_704_261_600_000_000_000  # 2024-01-03 06:00 UTC
    return mbo.scan(rec, symbols, "MNQ", "future_mbo", "2024-01-03", skip).select(F.col("order_id").alias("event_id"), "price_int", "action")


@query("WITH e AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'view'), p AS (SELECT event_id AS pid, user_id, ts, value FROM events WHERE event_type = 'purchase') SELECT e.event_id, p.pid AS pid_at, p.value AS value_at FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts")
def last_purchase(spark: SparkSession, d: str) -> DataFrame:
    """Each view with its user's last purchase until then."""
    e = market.table(spark, d, "events").withColumn("us", market.micros("ts"))
    views = e.filter("event_type = 'view'").select("event_id", "user_id", "us")
    buys = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("pid"), "user_id", F.col("us").alias("at"), "value")
    return joins.as_of(views, buys, ["user_id"], "us", "at", ["pid", "value"], DAY_US).select("event_id", "pid_at", "value_at")


@query("WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), p AS (SELECT event_id AS pid, user_id, ts FROM events WHERE event_type = 'purchase') SELECT e.event_id, CASE WHEN e.ts - p.ts <= INTERVAL 2 DAY THEN p.pid END AS pid_at FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts > p.ts")
def recent_purchase(spark: SparkSession, d: str) -> DataFrame:
    """Each view with its user's last earlier purchase, if it's at most two days old."""
    e = market.table(spark, d, "events").withColumn("us", market.micros("ts"))
    views = e.filter("event_type = 'view'").select("event_id", "user_id", "us")
    buys = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("pid"), "user_id", F.col("us").alias("at"))
    return joins.as_of(views, buys, ["user_id"], "us", "at", ["pid"], DAY_US, within=2 * DAY_US, strict=True).select("event_id", "pid_at")


@query("SELECT a.event_id, (SELECT arg_min(b.event_id, b.ts) FROM events b WHERE b.user_id = a.user_id AND b.ts >= a.ts + INTERVAL 1 HOUR) AS event_id_ahead FROM events a WHERE a.user_id < 20 UNION ALL SELECT a.event_id, (SELECT arg_min(b.event_id, b.ts) FROM events b WHERE b.user_id = a.user_id AND b.ts >= a.ts + INTERVAL 1 HOUR) FROM events a WHERE a.user_id >= 20")
def event_an_hour_later(spark: SparkSession, d: str) -> DataFrame:
    """Each event with its user's first event at least an hour later."""
    e = market.table(spark, d, "events").select("event_id", "user_id", market.micros("ts").alias("us"))
    return joins.ahead(e, ["user_id"], "us", market.HOUR_US, ["event_id"], DAY_US).select("event_id", "event_id_ahead")


@query("WITH a AS (SELECT o_custkey AS key, sum(o_totalprice) AS total, count(*) AS n FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey AS key, sum(o_totalprice) AS total, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1998-01-01' GROUP BY 1) SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' WHEN a.n IS NOT DISTINCT FROM b.n THEN 'unchanged' ELSE 'changed' END AS status, a.n AS n_old, b.n AS n_new FROM a FULL JOIN b ON a.key = b.key")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Customers by whether their number of orders before 1998 and since is new, gone, other or the same."""
    o = market.table(spark, d, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("date")
    side = lambda cond: o.filter(cond).groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))
    return joins.diff(side(early), side(~early), "key", ["n"])


@query("SELECT count(*) AS n_repeated FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")
def repeated_line_keys(spark: SparkSession, d: str) -> DataFrame:
    return quality.repeated_keys(market.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
