"""Shared pieces of oracle SQL (DuckDB): the lattice, its bins, silver and gold, and the order lifecycles."""

#: Events in bins, bin headers and the dense lattice.
LATTICE = """
t AS (SELECT epoch_us(min(ts)) AS t0, epoch_us(max(ts)) AS t1 FROM events),
ev AS (SELECT event_id, (epoch_us(ts) - t0) // 3600000000 AS bin_seq, CAST(user_id % 11 - 5 AS INTEGER) AS k, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events, t),
nb AS (SELECT unnest(range(0, (t1 - t0) // 3600000000 + 1)) AS bin_seq, t0 FROM t),
bins AS (SELECT nb.bin_seq, nb.t0 * 1000 + nb.bin_seq * 3600000000000 AS ts_ns, count(event_id) AS bin_event_count, coalesce(max(event_id), -1) AS event_id,
         coalesce(floor(4e0 * CAST(sum(cents) AS DOUBLE) / (100e0 * count(event_id)) + 5e-1) / 4, 0e0) AS mid_price, min(cents) AS best_bid, max(cents) AS best_ask
         FROM nb LEFT JOIN ev USING (bin_seq) GROUP BY nb.bin_seq, nb.t0),
kk AS (SELECT CAST(unnest(range(-5, 6)) AS INTEGER) AS k),
cells AS (SELECT nb.bin_seq, kk.k, CAST(coalesce(sum(cents) FILTER (event_type IN ('click', 'view')), 0) AS DOUBLE) / 100 AS v_add, CAST(coalesce(sum(cents) FILTER (event_type = 'error'), 0) AS DOUBLE) / 100 AS v_pull,
          CAST(coalesce(sum(cents) FILTER (event_type = 'purchase'), 0) AS DOUBLE) / 100 AS v_fill,
          CAST(coalesce(sum(cents) FILTER (event_type = 'signup'), 0) - coalesce(sum(cents) FILTER (event_type = 'purchase'), 0) AS DOUBLE) / 100 AS v_rest_depth, coalesce(max(event_id), -1) AS last_event_id
          FROM nb CROSS JOIN kk LEFT JOIN ev ON ev.bin_seq = nb.bin_seq AND ev.k = kk.k GROUP BY nb.bin_seq, kk.k)
"""

#: Moves of best prices and the lattice with time derivatives.
SILVER = (
    LATTICE
    + """,
moves AS (SELECT bin_seq, CAST(CASE WHEN best_ask > 0 AND lag(best_ask) OVER w > 0 THEN best_ask - lag(best_ask) OVER w ELSE 0 END AS INTEGER) AS best_ask_move_ticks,
          CAST(CASE WHEN best_bid > 0 AND lag(best_bid) OVER w > 0 THEN best_bid - lag(best_bid) OVER w ELSE 0 END AS INTEGER) AS best_bid_move_ticks FROM bins WINDOW w AS (ORDER BY bin_seq)),
signs AS (SELECT *, sign(best_ask_move_ticks) AS ask_reprice_sign, sign(best_bid_move_ticks) AS bid_reprice_sign FROM moves),
d1 AS (SELECT *, CASE WHEN bin_seq > 0 THEN (v_add - lag(v_add) OVER w) / 1e-1 ELSE 0 END AS a_add, CASE WHEN bin_seq > 0 THEN (v_pull - lag(v_pull) OVER w) / 1e-1 ELSE 0 END AS a_pull,
       CASE WHEN bin_seq > 0 THEN (v_fill - lag(v_fill) OVER w) / 1e-1 ELSE 0 END AS a_fill FROM cells WINDOW w AS (PARTITION BY k ORDER BY bin_seq)),
silver AS (SELECT d.*, CASE WHEN bin_seq > 0 THEN (a_add - lag(a_add) OVER w) / 1e-1 ELSE 0 END AS j_add, CASE WHEN bin_seq > 0 THEN (a_pull - lag(a_pull) OVER w) / 1e-1 ELSE 0 END AS j_pull,
           CASE WHEN bin_seq > 0 THEN (a_fill - lag(a_fill) OVER w) / 1e-1 ELSE 0 END AS j_fill, ask_reprice_sign, bid_reprice_sign FROM d1 d JOIN signs USING (bin_seq) WINDOW w AS (PARTITION BY k ORDER BY bin_seq))
"""
)

#: Forces, composite and its derivatives, and states by the moves of best prices.
FORCES = (
    SILVER
    + """,
pv AS (SELECT *, 1e0 * v_add + 5e-1 * greatest(v_rest_depth, 0) + 3e-1 * greatest(a_add, 0) AS pressure_variant,
       1e0 * v_pull + 15e-1 * v_fill + 5e-1 * greatest(-v_rest_depth, 0) + 3e-1 * greatest(a_pull, 0) AS vacuum_variant FROM silver),
raw AS (SELECT *, (pressure_variant - vacuum_variant) / (abs(pressure_variant) + abs(vacuum_variant) + 1e-12) AS c FROM pv),
comp AS (SELECT *, avg(c) OVER (PARTITION BY k ORDER BY bin_seq ROWS 4 PRECEDING) + avg(c) OVER (PARTITION BY k ORDER BY bin_seq ROWS 9 PRECEDING)
         + avg(c) OVER (PARTITION BY k ORDER BY bin_seq ROWS 19 PRECEDING) + avg(c) OVER (PARTITION BY k ORDER BY bin_seq ROWS 39 PRECEDING) AS composite FROM raw),
c1 AS (SELECT *, CASE WHEN bin_seq >= 1 THEN (composite - lag(composite) OVER w) / 1e-1 ELSE 0 END AS composite_d1 FROM comp WINDOW w AS (PARTITION BY k ORDER BY bin_seq)),
c2 AS (SELECT *, CASE WHEN bin_seq >= 2 THEN (composite_d1 - lag(composite_d1) OVER w) / 1e-1 ELSE 0 END AS composite_d2 FROM c1 WINDOW w AS (PARTITION BY k ORDER BY bin_seq)),
forces AS (SELECT *, CASE WHEN bin_seq >= 3 THEN (composite_d2 - lag(composite_d2) OVER w) / 1e-1 ELSE 0 END AS composite_d3,
           CASE WHEN k = 0 OR (ask_reprice_sign = 0 AND bid_reprice_sign = 0) OR (ask_reprice_sign < 0 AND bid_reprice_sign > 0) THEN 0
                WHEN bid_reprice_sign > 0 AND ask_reprice_sign >= 0 THEN CASE WHEN k > 0 THEN 2 ELSE 1 END ELSE CASE WHEN k > 0 THEN -1 ELSE -2 END END AS state5_code
           FROM c2 WINDOW w AS (PARTITION BY k ORDER BY bin_seq))
"""
)


def robust_z(x: str, window: int, least: int, keys: str = "", eps: str = "1e-12") -> str:
    """A robust z expression of a column over `keys` by bin_seq."""
    part = f"PARTITION BY {keys} " if keys else ""
    w = f"({part}ORDER BY bin_seq ROWS {window - 1} PRECEDING)"
    scale = f"1.4826e0 * mad({x}) OVER {w}"
    return f"CASE WHEN count({x}) OVER {w} >= least({least}, {window}) AND bin_seq + 1 >= {least} AND {scale} > {eps} THEN ({x} - median({x}) OVER {w}) / ({scale}) ELSE 0 END"


def slope(x: str, window: int, keys: str = "") -> str:
    """Least-squares slope over the last rows in closed form; NULL before the window is full."""
    part = f"PARTITION BY {keys} " if keys else ""
    w = f"({part}ORDER BY bin_seq ROWS {window - 1} PRECEDING)"
    spread = window * (window * window - 1) / 12
    return f"CASE WHEN bin_seq >= {window - 1} THEN (sum({x} * bin_seq) OVER {w} - (bin_seq - {(window - 1) / 2}e0) * sum({x}) OVER {w}) / {spread}e0 END"


def ema(x: str, alpha: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"list_reduce(list({x}) OVER ({part}ORDER BY bin_seq), lambda e, y: {alpha} * y + (1 - {alpha}) * e)"


#: Gold with scores.
_Z = ", ".join(f"{robust_z(f'composite_d{i}', 300, 75, 'k', '1e-9')} AS z{i}" for i in (1, 2, 3))
GOLD = (
    FORCES
    + f""",
zs AS (SELECT *, {_Z} FROM forces),
sc AS (SELECT *, greatest(-1e0, least(1e0, (55e-2 * tanh(z1 / 3e0) + 30e-2 * tanh(z2 / 3e0) + 15e-2 * tanh(z3 / 3e0)) / 1e0)) AS flow_score FROM zs),
gold AS (SELECT *, CASE WHEN flow_score >= 15e-2 THEN 1 WHEN flow_score <= -15e-2 THEN -1 ELSE 0 END AS flow_state_code FROM sc)
"""
)

#: Order lifecycles from lines and orders; an order's number stands for its id.
ORDERS = """
ln AS (SELECT row_number() OVER () AS order_id, CASE WHEN l_linestatus = 'F' THEN 'B' ELSE 'A' END AS side, CAST(l_quantity AS BIGINT) AS quantity,
       CAST(floor(l_extendedprice / l_quantity / 1000) AS INTEGER) AS tick, l_returnflag, epoch_us(o_orderdate) AS o, epoch_us(l_shipdate) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
oe AS (SELECT order_id, side, tick, least(o, s) AS us, 0 AS step, 'A' AS action, quantity AS size FROM ln
       UNION ALL SELECT order_id, side, tick, greatest(o, s), 1, CASE WHEN l_returnflag = 'R' THEN 'C' ELSE 'F' END,
       CASE l_returnflag WHEN 'A' THEN quantity WHEN 'N' THEN quantity // 2 ELSE 0 END FROM ln),
delta AS (SELECT us, side, tick, step, action, CASE WHEN step = 0 THEN size WHEN action = 'C' THEN -q ELSE -size END AS d
          FROM (SELECT *, first(size) OVER (PARTITION BY order_id ORDER BY step) AS q FROM oe))
"""


def rnd(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in columns)
