"""The order book as windows over orders: signed changes, depth, best prices and order states.

An order is touched by few events, so its state after each event is a window over the order; a cleared
book starts a new epoch, and an order id of another epoch is another order. Depth is a running sum of
signed changes by side and tick; `levels` has it as intervals, and best prices from these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.totals import running_totals
from tidebook.schemas import FLAG_LAST, FLAG_SNAPSHOT


#: Clears up to which their numbers go into the plan; a session has one or two.
FEW_CLEARS = 1000


def clears(events: DataFrame) -> list[int] | None:
    """The numbers of the events that clear the book, if they are few."""
    found = [r["seq"] for r in events.filter("action = 'R'").select("seq").limit(FEW_CLEARS + 1).collect()]
    return found if len(found) <= FEW_CLEARS else None


def with_epochs(events: DataFrame, few: list[int] | None = None) -> DataFrame:
    """``epoch``: how often the book was cleared up to the event (action R). `few` is what `clears` found."""
    if few is not None:
        at = F.array(*[F.lit(x).cast("long") for x in sorted(few)]) if few else F.array().cast("array<bigint>")
        return events.withColumn("epoch", F.size(F.filter(at, lambda x: x <= F.col("seq"))).cast("long"))
    cleared = events.withColumn("_r", (F.col("action") == "R").cast("long"))
    return running_totals(cleared, [], "seq", {"epoch": "_r"}, chunk=1 << 20).drop("_r")


def book_valid(events: DataFrame) -> DataFrame:
    """``valid``: not inside a snapshot. A clear with the snapshot flag opens one, the next last-flag closes it.

    A clear without the flag leaves the book valid at once. Needs `seq`; all columns stay.
    """
    opens = (F.col("action") == "R") & (F.col("flags").bitwiseAND(FLAG_SNAPSHOT) != 0)
    closes = F.col("flags").bitwiseAND(FLAG_LAST) != 0
    df = events.withColumn("_open", opens.cast("long")).withColumn("_n", F.lit(1).cast("long"))
    df = running_totals(df, [], "seq", {"_snapshot": "_open"}, chunk=1 << 20)
    first_close = df.filter((F.col("_snapshot") > 0) & closes).groupBy("_snapshot").agg(F.min("seq").alias("_closed"))
    df = df.join(first_close, "_snapshot", "left")
    valid = (F.col("_snapshot") == 0) | F.coalesce(F.col("seq") >= F.col("_closed"), F.lit(False))
    return df.withColumn("valid", valid).drop("_open", "_n", "_snapshot", "_closed")


def order_states(events: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Events with ``qty`` and ``at_side, at_tick`` of their order afterwards and ``was_*`` before (null or 0: not there).

    ``newest`` is the last event of an order in its epoch.

    `within` are columns of which an order has one value; events that are partitioned by them aren't shuffled.

    Add and modify set the order, cancel removes all of it whatever size it names, fill takes at most what is
    left, trades and other actions change nothing.
    """
    df = events if "epoch" in events.columns else with_epochs(events, clears(events))
    by_order = Window.partitionBy(*within, "order_id", "epoch").orderBy("seq")
    running = by_order.rowsBetween(Window.unboundedPreceding, 0)
    sets = F.col("action").isin("A", "M")
    df = df.withColumn("_f", F.sum(F.when(F.col("action") == "F", F.col("size")).otherwise(0)).over(running))
    base = F.last(F.when(sets, F.col("size")).when(F.col("action") == "C", 0), ignorenulls=True).over(running)
    # fills since the order was set: all of them, less those until then
    before = F.last(F.when(sets | (F.col("action") == "C"), F.col("_f")), ignorenulls=True).over(running)
    df = df.withColumn("qty", F.greatest(base - F.col("_f") + before, F.lit(0)))
    for x in ("side", "tick"):
        df = df.withColumn(f"at_{x}", F.last(F.when(sets, F.col(x)), ignorenulls=True).over(running))
    before = {f"was_{x}": F.lag(y).over(by_order) for x, y in (("qty", "qty"), ("side", "at_side"), ("tick", "at_tick"))}
    return df.withColumns(before | {"newest": F.lead(F.lit(True)).over(by_order).isNull()}).drop("_f")


def changes(events: DataFrame, few: list[int] | None = None, within: Sequence[str] = ()) -> DataFrame:
    """One row per touched place: ``seq, ts_ns, side, tick, d_depth, add, pull, fill, touched``.

    A modified price pulls the old order and adds the new one; at the same price the difference counts. A
    modified order that isn't known enters the book without counting as an addition. `touched` rows count
    for the mechanics of their tick. Clears leave one row per order that was there. `few` are the numbers of the clearing
    events where they are known, else they are looked up; `within` as in `order_states`.
    """
    few = clears(events) if few is None else few
    return state_changes(order_states(with_epochs(events, few), within), few)


def state_changes(s: DataFrame, few: list[int] | None = None) -> DataFrame:
    """`changes` from what `order_states` returns; `few` are the numbers of the clearing events if they are known."""
    known = F.coalesce(F.col("was_qty") > 0, F.lit(False))
    zero = F.lit(0).cast("long")

    def row(side, tick, depth, add=zero, pull=zero, fill=zero, touched=True):
        return F.struct(side.alias("side"), tick.cast("int").alias("tick"), depth.cast("long").alias("d_depth"), add.cast("long").alias("add"), pull.cast("long").alias("pull"), fill.cast("long").alias("fill"), F.lit(touched).alias("touched"))

    size, was, side, tick = F.col("size"), F.col("was_qty"), F.col("side"), F.col("tick")
    old_side, old_tick = F.col("was_side"), F.col("was_tick")
    same = (side == old_side) & (tick == old_tick)
    taken = F.least(size, was)
    plus = lambda x: F.greatest(x, F.lit(0))
    rows = (
        F.when(F.col("action") == "A", F.array(row(side, tick, size, add=size)))
        .when((F.col("action") == "C") & known, F.array(row(old_side, old_tick, -was, pull=was)))
        .when((F.col("action") == "F") & known, F.array(row(old_side, old_tick, -taken, fill=taken)))
        .when((F.col("action") == "M") & known & same, F.array(row(side, tick, size - was, add=plus(size - was), pull=plus(was - size))))
        .when((F.col("action") == "M") & known, F.array(row(old_side, old_tick, -was, pull=was), row(side, tick, size, add=size)))
        .when(F.col("action") == "M", F.array(row(side, tick, size, touched=False)))
    )
    found = s.select("seq", "ts_ns", F.explode(rows).alias("r")).select("seq", "ts_ns", "r.*")
    if few == []:
        return found
    ends = s.filter("action = 'R'").select((F.col("epoch") - 1).alias("epoch"), F.col("seq").alias("at"), F.col("ts_ns").alias("at_ns"))
    gone = s.filter("newest and qty > 0").select("epoch", "qty", "at_side", "at_tick").join(ends, "epoch").select(F.col("at").alias("seq"), F.col("at_ns").alias("ts_ns"), F.col("at_side").alias("side"), F.col("at_tick").cast("int").alias("tick"), (-F.col("qty")).cast("long").alias("d_depth"), *[zero.alias(x) for x in ("add", "pull", "fill")], F.lit(False).alias("touched"))
    return found.unionByName(gone)


def resting(events: DataFrame) -> DataFrame:
    """Orders still in the book at the end: ``order_id, side, tick, qty``; the checkpoint of a replay."""
    few = clears(events)
    events = with_epochs(events, few)
    return state_resting(order_states(events), events if few is None else few)


def state_resting(s: DataFrame, few: list[int] | DataFrame) -> DataFrame:
    """`resting` from what `order_states` returns; `few` are the clears, or rows with all epochs where these are many."""
    newest = F.broadcast(few.agg(F.max("epoch").alias("epoch"))) if isinstance(few, DataFrame) else None
    last = s.filter("newest and qty > 0")
    last = last.filter(F.col("epoch") == len(few)) if newest is None else last.join(newest, "epoch")
    return last.select("order_id", F.col("at_side").alias("side"), F.col("at_tick").alias("tick"), "qty")


def depth(changed: DataFrame, bins: DataFrame) -> DataFrame:
    """Dense depth at the end of every bin: ``bin_seq, side, tick, depth`` for the ticks that ever change.

    `changed` has ``bin_seq, side, tick, d_depth``, `bins` one row per bin.
    """
    ticks = changed.select("side", "tick").distinct()
    spans = bins.agg(F.min("bin_seq").alias("a"), F.max("bin_seq").alias("z")).first()
    zero = ticks.withColumn("bin_seq", F.explode(F.sequence(F.lit(spans["a"]).cast("long"), F.lit(spans["z"]).cast("long")))).withColumn("d_depth", F.lit(0).cast("long"))
    per_bin = changed.select("side", "tick", "bin_seq", "d_depth").unionByName(zero).groupBy("side", "tick", "bin_seq").agg(F.sum("d_depth").alias("d_depth"))
    return running_totals(per_bin, ["side", "tick"], "bin_seq", {"depth": "d_depth"})


def anchor(changed: DataFrame, after: int = 0, at_ns: int | None = None, chunk: int = 1 << 20) -> dict | None:
    """``seq, best_bid, best_ask, anchor`` of the first moment when both sides have depth; null if there's none.

    The anchor is the middle of the best prices, halves up. With `after` or `at_ns` it's the first such moment
    with at least so many changes so far, or at that time or later: the one-time re-anchor of a run. Changes of
    one `seq` count together. `chunk` is a range of `seq` with a bounded number of changes.
    """
    on = lambda side: F.sum(F.when(F.col("side") == side, F.col("d_depth")).otherwise(0))
    steps = changed.groupBy("seq").agg(on("B").alias("b"), on("A").alias("a"), F.count("*").alias("n"), F.max("ts_ns").alias("ts_ns"))
    due = F.col("so_far") >= after
    if at_ns is not None:
        due = due | (F.col("ts_ns") >= at_ns)
    sums = running_totals(steps, [], "seq", {"bid": "b", "ask": "a", "so_far": "n"}, chunk=chunk)
    seq = sums.filter((F.col("bid") > 0) & (F.col("ask") > 0) & due).agg(F.min("seq")).first()[0]
    if seq is None:
        return None
    there = changed.filter(F.col("seq") <= seq).groupBy("side", "tick").agg(F.sum("d_depth").alias("depth")).filter("depth > 0")
    best = there.agg(F.max(F.when(F.col("side") == "B", F.col("tick"))).alias("best_bid"), F.min(F.when(F.col("side") == "A", F.col("tick"))).alias("best_ask")).first()
    return {"seq": seq, **best.asDict(), "anchor": (best["best_bid"] + best["best_ask"] + 1) // 2}


def restarted(changed: DataFrame, seq: int) -> DataFrame:
    """Changes whose masses and chains start anew after `seq`, as a re-anchor does; depth stays."""
    new = F.col("seq") > seq
    zero = F.lit(0).cast("long")
    return changed.withColumns({**{c: F.when(new, F.col(c)).otherwise(zero) for c in ("add", "pull", "fill")}, "touched": F.col("touched") & new})


def first_price(events: DataFrame) -> int | None:
    """The tick of the first add, modify, fill or cancel that has one (the least of equals): the anchor of a full grid."""
    priced = events.filter(F.col("action").isin("A", "M", "F", "C") & F.col("tick").isNotNull())
    return priced.agg(F.min(F.struct("seq", "tick")).alias("x")).select("x.tick").first()[0]


def full_grid(changed: DataFrame, bins: DataFrame, at: int, half: int, strict: bool = False) -> DataFrame:
    """``bin_seq, side, cell, depth`` on all cells of the grid of 2 * half + 1 ticks around `at`, whatever the spot.

    Changes outside the grid are dropped, or are an error if `strict`.
    """
    cell = (F.col("tick") - at + half).cast("int")
    inside = cell.between(0, 2 * half)
    if strict:
        said = F.concat(F.lit("tick "), F.col("tick").cast("string"), F.lit(f" is outside the grid of {half} ticks around {at}"))
        inside = F.when(inside, True).otherwise(F.raise_error(said).cast("boolean"))
    there = changed.filter(inside).select("side", cell.alias("tick"), "bin_seq", "d_depth")
    first = bins.agg(F.min("bin_seq").alias("bin_seq")).filter("bin_seq is not null")
    cells = first.select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("side"), "bin_seq").select("side", F.explode(F.sequence(F.lit(0), F.lit(2 * half))).alias("tick"), "bin_seq", F.lit(0).cast("long").alias("d_depth"))
    return depth(there.unionByName(cells), bins).select("bin_seq", "side", F.col("tick").alias("cell"), "depth")
