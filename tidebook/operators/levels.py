"""Depth of the book kept sparse: validity intervals, best prices from dyadic spans, depth around a price.

A tick keeps its depth from one change to the next, so depth is one interval ``since <= bin < until`` per change rather than
one row per tick and bin. What is asked of all ticks at a bin (the highest bid with depth) is answered from spans whose
lengths are powers of two: an interval is the union of at most two spans of each length, each span keeps the extreme of its
intervals, and a bin asks the spans that contain it, one of each length. Rows so grow with the changes and the bins, each
times the logarithm of the bins, and never with ticks times bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.totals import running_totals


def intervals(changed: DataFrame) -> DataFrame:
    """``side, tick, since, until, depth``: the depth of a tick in bins since <= bin < until; a null `until` is no end.

    `changed` has ``bin_seq, side, tick, d_depth``; changes of one bin count together, and a tick without depth has no row.
    """
    per_bin = changed.groupBy("side", "tick", "bin_seq").agg(F.sum("d_depth").alias("d")).filter("d <> 0")
    steps = running_totals(per_bin, ["side", "tick"], "bin_seq", {"depth": "d"}, following="until")
    return steps.filter("depth <> 0").select("side", "tick", F.col("bin_seq").alias("since"), "until", "depth")


def spans(df: DataFrame, since: str, until: str, levels: int) -> DataFrame:
    """A row for each of the dyadic spans that make up ``since <= x < until``: ``level, at`` for x of [at, at + 1) * 2**level.

    `levels` is the number of span lengths; intervals lie within 0 and 2**(levels - 1).
    """
    parts = []
    for level in range(levels):
        # what is left of the interval after the shorter spans: it starts at `a` and ends before `z` spans of this length
        a, z = F.shiftright(F.col(since) + ((1 << level) - 1), level), F.shiftright(F.col(until), level)
        odd = lambda x, a=a, z=z: (x.bitwiseAND(F.lit(1)) == 1) & (a < z)
        span = lambda x, level=level: F.struct(F.lit(level).alias("level"), x.alias("at"))
        parts += [F.when(odd(a), span(a)), F.when(odd(z), span(z - 1))]
    parts = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return df.withColumn("_span", F.explode(parts)).select(*df.columns, "_span.level", "_span.at")


#: Spans of 2**BLOCK bins and more are asked once for a block of so many bins, not by each of its bins.
BLOCK = 10


def best_prices(held: DataFrame, first: int, last: int, block: int = BLOCK) -> DataFrame:
    """``bin_seq, best_bid, best_ask, bid_depth, ask_depth, spot, n_negative`` of every bin from first to last.

    `held` are intervals. Best prices are extremes of the ticks with depth, the spot is their middle, halves up, null if a
    side is empty; depths are totals of a side. Negative depth is counted, not repaired.
    """
    spark, n = held.sparkSession, last - first + 1
    levels = max(n - 1, 0).bit_length() + 1
    df = held.withColumns({"since": F.col("since") - first, "until": F.coalesce("until", F.lit(last + 1)) - first})
    df = df.filter(f"until > 0 and since < {n}").withColumns({"since": F.greatest("since", F.lit(0)), "until": F.least("until", F.lit(n))})
    extreme = lambda side, f: f(F.when(F.col("side") == side, F.col("tick")))
    bins = spark.range(n).withColumnRenamed("id", "bin")
    best = spans(df.filter("depth > 0").select("side", "tick", "since", "until"), "since", "until", levels).groupBy("level", "at").agg(extreme("B", F.max).alias("best_bid"), extreme("A", F.min).alias("best_ask"))

    def asking(count: int, lengths: range) -> DataFrame:
        """The best of the spans around each of some numbers, which count spans of the shortest length."""
        asked = spark.range(count).select("id", F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.shiftright("id", x - lengths[0]).alias("at")) for x in lengths])).alias("s")).select("id", "s.*")
        return asked.join(best, ["level", "at"]).groupBy("id").agg(F.max("best_bid").alias("best_bid"), F.min("best_ask").alias("best_ask"))

    if levels > block + 1:
        long = asking(((n - 1) >> block) + 1, range(block, levels)).select(F.lit(block).alias("level"), F.col("id").alias("at"), "best_bid", "best_ask")
        best = best.filter(F.col("level") < block).unionByName(long)
    prices = asking(n, range(min(levels, block + 1))).withColumnRenamed("id", "bin")
    # totals of all ticks: what an interval adds where it begins it takes away where it ends
    of = lambda side: F.when((F.col("side") == side) & (F.col("depth") > 0), F.col("depth")).otherwise(0)
    values = {"bid_depth": of("B"), "ask_depth": of("A"), "n_negative": (F.col("depth") < 0).cast("long")}
    edge = lambda at, sign: df.select(F.col(at).alias("bin"), *[(sign * v).alias(f"_{c}") for c, v in values.items()])
    edges = edge("since", 1).unionByName(edge("until", -1)).filter(f"bin < {n}").unionByName(bins.select("bin", *[F.lit(0).cast("long").alias(f"_{c}") for c in values]))
    totals = running_totals(edges.groupBy("bin").agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in values]), [], "bin", {c: f"_{c}" for c in values})
    out = totals.select("bin", *values).join(prices, "bin", "left").withColumn("spot", F.floor((F.col("best_bid") + F.col("best_ask")) / 2 + 0.5))
    return out.select((F.col("bin") + first).alias("bin_seq"), "best_bid", "best_ask", "bid_depth", "ask_depth", "n_negative", "spot")


def around_spot(changed: DataFrame, best: DataFrame, radius: int) -> DataFrame:
    """``bin_seq, k, bid_depth, ask_depth``: depth by distance from the spot, zeros where a tick has none.

    Places asked for enter the changes as changes by nothing, so one running total by tick answers them: rows are those of
    the changes and of the result. Ticks farther than `radius` are left out; bins without a spot have no rows.
    """
    spots = best.filter("spot is not null").select("bin_seq", F.col("spot").cast("int").alias("spot"))
    asked = spots.select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("side"), "bin_seq", "spot").select("side", "bin_seq", "spot", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("k"))
    asked = asked.select("side", (F.col("spot") + F.col("k")).alias("tick"), "bin_seq", F.lit(0).cast("long").alias("d"), "k")
    per_bin = changed.groupBy("side", "tick", "bin_seq").agg(F.sum("d_depth").alias("d"))
    both = per_bin.withColumn("k", F.lit(None).cast("int")).unionByName(asked).groupBy("side", "tick", "bin_seq").agg(F.sum("d").alias("d"), F.max("k").alias("k"))
    near = running_totals(both, ["side", "tick"], "bin_seq", {"depth": "d"}).filter("k is not null")
    side = lambda x: F.sum(F.when(F.col("side") == x, F.col("depth")).otherwise(0)).alias
    return near.groupBy("bin_seq", "k").agg(side("B")("bid_depth"), side("A")("ask_depth"))
