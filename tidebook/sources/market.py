"""The engine's inputs made from the star-schema and event tables.

`events` stand for order-book activity: a bin is a whole hour since the first event, the price level ``k`` is
``user_id % 11 - 5``, and the event types are additions (click, view), pulls (error), fills (purchase) and
resting changes (signup less purchase). Values are summed in whole cents, so sums don't depend on order.
`orders` and `lineitem` stand for order lifecycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions import windows as W
from tidebook.functions.chunks import over_chunks

RADIUS = 5
HOUR_US = 3_600_000_000
#: Order lines of a task, beyond the lines that the session's own number of partitions takes. A line is sorted with its
#: order and once a window, its two events too, which takes some 1,200 bytes a line (290 MB a task as measured).
TASK_LINES = 250_000
#: Bins count as a tenth of a second wherever derivatives ask for time.
SECONDS = 0.1
CENTS = {"add": ("click", "view"), "pull": ("error",), "fill": ("purchase",), "signup": ("signup",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def binned(events: DataFrame, t0: int) -> DataFrame:
    """``event_id, ts_us, bin_seq, k, event_type, cents`` of the events; `t0` is the first one's microseconds."""
    return events.select(
        "event_id", micros("ts").alias("ts_us"), F.expr(f"(unix_micros(cast(ts as timestamp)) - {t0}) div {HOUR_US}").alias("bin_seq"), (F.col("user_id") % (2 * RADIUS + 1) - RADIUS).cast("int").alias("k"),
        "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


def span(events: DataFrame) -> tuple[int, int]:
    """The first event's microseconds and the number of bins: two numbers for the driver."""
    row = events.agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("a"), F.unix_micros(F.max("ts").cast("timestamp")).alias("z")).first()
    return (0, 0) if row["a"] is None else (row["a"], (row["z"] - row["a"]) // HOUR_US + 1)


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header of every bin, empty ones too: ``bin_seq, ts_ns, bin_event_count, event_id, mid_price, best_bid, best_ask``.

    The mid price is the mean value in quarters, halves up; best bid and ask are the least and largest value
    in cents. An empty bin has mid price 0, no best prices and event id -1.
    """
    events = table(spark, sf_dir, "events")
    t0, n = span(events)
    empty = spark.range(n).select(F.col("id").alias("bin_seq"), *[F.lit(None).cast("long").alias(c) for c in ("event_id", "cents")])
    rows = binned(events, t0).select("bin_seq", "event_id", "cents").unionByName(empty)
    df = rows.groupBy("bin_seq").agg(F.count("event_id").alias("bin_event_count"), F.coalesce(F.max("event_id"), F.lit(-1)).alias("event_id"), F.sum("cents").alias("cents"), F.min("cents").alias("best_bid"), F.max("cents").alias("best_ask"))
    mid = F.floor(4.0 * F.col("cents") / (100.0 * F.col("bin_event_count")) + 0.5) / 4
    return df.select("bin_seq", (F.lit(t0) * 1000 + F.col("bin_seq") * HOUR_US * 1000).alias("ts_ns"), "bin_event_count", "event_id", F.coalesce(mid, F.lit(0.0)).alias("mid_price"), F.col("best_bid").cast("long").alias("best_bid"), F.col("best_ask").cast("long").alias("best_ask"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense lattice: ``bin_seq, k, v_add, v_pull, v_fill, v_rest_depth, last_event_id``, zeros where nothing happened.

    Zero rows are put in before the sums, so densifying needs no join and no second shuffle.
    """
    events = table(spark, sf_dir, "events")
    t0, n = span(events)
    zero = spark.range(n).select(F.col("id").alias("bin_seq"), F.explode(F.sequence(F.lit(-RADIUS), F.lit(RADIUS))).alias("k"), F.lit(None).cast("string").alias("event_type"), F.lit(0).cast("long").alias("cents"), F.lit(-1).cast("long").alias("event_id"))
    rows = binned(events, t0).select("bin_seq", "k", "event_type", "cents", "event_id").unionByName(zero)
    total = lambda kinds: F.sum(F.when(F.col("event_type").isin(*kinds), F.col("cents")).otherwise(0))
    df = rows.groupBy("bin_seq", "k").agg(*[total(kinds).alias(name) for name, kinds in CENTS.items()], F.max("event_id").alias("last_event_id"))
    return df.select("bin_seq", "k", *[(F.col(x) / 100.0).alias(f"v_{x}") for x in ("add", "pull", "fill")], ((F.col("signup") - F.col("fill")) / 100.0).alias("v_rest_depth"), "last_event_id")


def signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of best prices against the bin before: ``bin_seq, best_*_move_ticks, *_reprice_sign, microstate_id, chase_*_flag``."""
    def build(df: DataFrame, axis) -> DataFrame:
        return df.select("*", W.move(axis, "best_ask").cast("int").alias("best_ask_move_ticks"), W.move(axis, "best_bid").cast("int").alias("best_bid_move_ticks"))

    df = over_chunks(bins(spark, sf_dir).select("bin_seq", "best_ask", "best_bid"), [], "bin_seq", 1, build)
    ask, bid = F.signum("best_ask_move_ticks").cast("tinyint"), F.signum("best_bid_move_ticks").cast("tinyint")
    df = df.select("bin_seq", "best_ask_move_ticks", "best_bid_move_ticks", ask.alias("ask_reprice_sign"), bid.alias("bid_reprice_sign"))
    a, b = F.col("ask_reprice_sign"), F.col("bid_reprice_sign")
    return df.select("*", W.microstate(a, b).alias("microstate_id"), ((a > 0) & (b > 0)).cast("tinyint").alias("chase_up_flag"), ((a < 0) & (b < 0)).cast("tinyint").alias("chase_down_flag"))


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice with accelerations and jerks (first and second time derivatives of the velocities) and the price moves of its bin."""
    def build(df: DataFrame, axis) -> DataFrame:
        for x in ("add", "pull", "fill"):
            d1, d2, _ = W.derivatives(axis, f"v_{x}", SECONDS, strict=False)
            df = df.withColumns({f"a_{x}": d1, f"j_{x}": d2})
        return df

    return over_chunks(cells(spark, sf_dir), ["k"], "bin_seq", 3, build).join(signs(spark, sf_dir), "bin_seq")


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lifecycles: ``ts_ns, step, action, side, tick, price_int, size, order_id, flags, order_key, order_row``, two rows per line.

    A line is added at the earlier of its order and ship date and ends at the later one: cancelled (R), filled
    (A) or half filled (N). The lines of an order stay together in tasks of a bounded size. Line keys repeat, so an order id is a hash of all columns and of the number of the row
    among equal ones; equal rows have one order key, so they are numbered where the join has brought them. Ties in
    time put additions first.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    columns = sorted(lines.columns)
    parts = -(-lines.count() // TASK_LINES)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines = lines.repartition(parts, "l_orderkey")
    number = F.row_number().over(Window.partitionBy("l_orderkey", "row").orderBy(F.lit(0)))
    df = lines.withColumn("row", F.xxhash64(*columns)).join(orders, "l_orderkey").withColumn("copy", number)
    df = df.select(
        F.xxhash64("row", "copy").alias("order_id"), F.col("l_orderkey").alias("order_key"), F.col("row").alias("order_row"), F.when(F.col("l_linestatus") == "F", "B").otherwise("A").alias("side"), F.col("l_quantity").cast("long").alias("quantity"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 1000).cast("int").alias("tick"), "l_returnflag",
        micros("o_orderdate").alias("o"), micros("l_shipdate").alias("s"),
    )
    end = F.when(F.col("l_returnflag") == "R", "C").otherwise("F")
    filled = F.when(F.col("l_returnflag") == "A", F.col("quantity")).when(F.col("l_returnflag") == "N", F.floor(F.col("quantity") / 2)).otherwise(0)
    both = F.array(
        F.struct(F.least("o", "s").alias("us"), F.lit(0).alias("step"), F.lit("A").alias("action"), F.col("quantity").alias("size")),
        F.struct(F.greatest("o", "s").alias("us"), F.lit(1).alias("step"), end.alias("action"), filled.cast("long").alias("size")),
    )
    df = df.select("order_id", "order_key", "order_row", "side", "tick", F.explode(both).alias("e")).select("order_id", "order_key", "order_row", "side", "tick", "e.*")
    return df.select((F.col("us") * 1000).alias("ts_ns"), "step", "action", "side", "tick", (F.col("tick").cast("long") * 1_000_000_000).alias("price_int"), "size", "order_id", F.lit(128).alias("flags"), "order_key", "order_row")
