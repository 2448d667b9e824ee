"""Structured Streaming twins: tumbling bins with a watermark, and detection with cooldown as keyed state."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebook.sources.files import scratch


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """``start, n, last_id, total`` per bin, once the watermark has passed its end. Later rows of it are dropped."""
    binned = stream.withWatermark("at", late).groupBy(F.window("at", width).alias("w"))
    return binned.agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"), F.sum("cents").alias("total")).select(F.col("w.start").alias("start"), "n", "last_id", "total")


def detected(stream: DataFrame, threshold: float, cooldown: int) -> DataFrame:
    """``user_id, event_id, direction`` of shots per user: a value enters the upper or lower state, at least `cooldown`
    events of the user after the last shot. State per user: number of events, state, last shot.

    A batch's rows of a user are taken in the order of their ids, so triggers may cut the stream anywhere.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, before, last = state.get if state.exists else (0, 0, -cooldown)
        rows = pd.concat(list(batches)).sort_values("event_id")
        ids, ways = [], []
        for event_id, value in zip(rows["event_id"], rows["value"], strict=True):
            now = 1 if value >= threshold else -1 if value <= threshold / 10 else 0
            if now and now != before and n - last >= cooldown:
                ids.append(event_id)
                ways.append("up" if now > 0 else "down")
                last = n
            before, n = now, n + 1
        state.update((n, before, last))
        yield pd.DataFrame({"user_id": [key[0]] * len(ids), "event_id": ids, "direction": ways})

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, direction string", "n bigint, before int, last bigint", "append", GroupStateTimeout.NoTimeout)


#: Rows of a level that are given out at once.
BLOCK = 65_536


def closed_bins(key, at: int, until: int, opened: dict[int, tuple[int, int]], mass: float, keep: float) -> Iterator[pd.DataFrame]:
    """``k, bin_seq, n, total, mass`` of the bins at <= bin < until, in blocks; `opened` has count and sum of those with rows."""
    while at < until:
        end = min(until, at + BLOCK)
        n, total, masses = np.zeros(end - at, np.int64), np.zeros(end - at, np.int64), np.zeros(end - at)
        since = at
        for b in [*sorted(x for x in opened if at <= x < end), end]:
            # bins without rows only forget
            masses[since - at : b - at] = mass * keep ** np.arange(1, b - since + 1)
            mass *= keep ** (b - since)
            if b < end:
                n[b - at], total[b - at] = opened[b]
                mass = masses[b - at] = mass * keep + opened[b][1]
                since = b + 1
        yield pd.DataFrame({"k": [key] * (end - at), "bin_seq": np.arange(at, end), "n": n, "total": total, "mass": masses})
        at = end


def after(opened: dict[int, tuple[int, int]], at: int, until: int, mass: float, keep: float) -> float:
    """The mass when bins at <= bin < until have closed."""
    for b in sorted(x for x in opened if at <= x < until):
        mass, at = mass * keep ** (b + 1 - at) + opened[b][1], b + 1
    return mass * keep ** (until - at)


def filled(stream: DataFrame, width_us: int, tau: float, emit_from: int = 0, late_us: int = 0) -> DataFrame:
    """``k, bin_seq, n, total, mass`` of every closed bin of each level, from its first row on; empty bins too.

    Rows are ``k, at_us, seen, cents``: `seen` is the timestamp at which a row came in, and comes in order. ``mass`` sums up
    the cents and decays by exp(-1 / tau) a bin. A bin is closed `late_us` after its end, and a row counts if it was seen
    before that: this is told from the row alone, so it doesn't matter where triggers cut the stream. The watermark of
    `seen` closes bins by timers, those of levels that are silent too. Bins before `emit_from` count for the mass but aren't
    emitted. State per level: the first bin that isn't closed, the mass before it, and counts and sums of the open bins.
    What is still open when a stream ends is in `remaining`. A null level is a level; a row without a time counts nowhere,
    but moves the watermark.
    """
    keep = math.exp(-1 / tau)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, sealed, mass, bins, ns, totals = state.get if state.exists else (None, None, 0.0, [], [], [])
        opened = {b: (n, t) for b, n, t in zip(bins, ns, totals, strict=True)}
        for rows in () if state.hasTimedOut else batches:
            sums = rows["cents"].fillna(0).astype("int64").groupby(rows["bin_seq"]).agg(["size", "sum"])
            for b, size, cents in zip(sums.index.tolist(), sums["size"].tolist(), sums["sum"].tolist(), strict=True):
                if sealed is None or b >= sealed:
                    n, t = opened.get(b, (0, 0))
                    opened[b] = n + size, t + cents
        if at is None or sealed is None:
            at = min(opened, default=at)
        if at is None:
            return
        until = (state.getCurrentWatermarkMs() * 1000 - late_us) // width_us
        if until > at:
            for block in closed_bins(key[0], at, until, opened, mass, keep):
                yield block[block["bin_seq"] >= emit_from]
            mass, at, sealed = after(opened, at, until, mass, keep), until, until
            opened = {b: x for b, x in opened.items() if b >= until}
        state.update((at, sealed, mass, list(opened), [n for n, _ in opened.values()], [t for _, t in opened.values()]))
        state.setTimeoutTimestamp(max(-(-((at + 1) * width_us + late_us) // 1000), state.getCurrentWatermarkMs() + 1))

    known = stream.withWatermark("seen", "0 seconds").withColumn("bin_seq", F.floor(F.col("at_us") / width_us))
    known = known.filter(F.col("at_us").isNull() | (F.unix_micros("seen") < (F.col("bin_seq") + 1) * width_us + late_us))
    kinds = "at bigint, sealed bigint, mass double, bins array<bigint>, ns array<bigint>, totals array<bigint>"
    return known.groupBy("k").applyInPandasWithState(step, "k int, bin_seq bigint, n bigint, total bigint, mass double", kinds, "append", GroupStateTimeout.EventTimeTimeout)


def remaining(spark: SparkSession, state: str, last: int, tau: float, emit_from: int = 0) -> DataFrame:
    """What `filled` still holds open in its checkpoint, as closed at the stream's end: all levels up to the bin `last`."""
    keep = math.exp(-1 / tau)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k, at, mass, bins, ns, totals in rows.itertuples(index=False):
                for block in closed_bins(None if pd.isna(k) else int(k), int(at), last + 1, {int(b): (int(n), int(t)) for b, n, t in zip(bins, ns, totals, strict=True)}, mass, keep):
                    yield block[block["bin_seq"] >= emit_from]

    held = spark.read.format("statestore").load(state)
    held = held.select("key.*", "value.groupState.*").toDF("k", "at", "sealed", "mass", "bins", "ns", "totals").drop("sealed").filter("at is not null")
    return held.mapInPandas(ends, "k int, bin_seq bigint, n bigint, total bigint, mass double")


def carried(stream: DataFrame, key: str, order: str, values: list[str], halo: int, kernel: Callable[[pd.DataFrame], pd.DataFrame], added: str) -> DataFrame:
    """The streaming twin of `apply_chunks`: ``key, order`` and the columns that `kernel` adds to rows of doubles.

    State per key are the last `halo` rows, which is all that a batch's rows look back on; so a batch has
    the values that a run over the whole series has. Batches come in order; a row that isn't later than the last
    one seen is dropped, so a batch that is sent twice changes nothing.
    """
    names = [c.split()[0] for c in added.split(",")]
    key_type, order_type = (stream.schema[c].dataType.simpleString() for c in (key, order))

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        orders, flat = state.get if state.exists else ([], [])
        tail = pd.DataFrame(np.asarray(flat, float).reshape(len(orders), len(values)), columns=values)
        tail.insert(0, order, np.asarray(orders, np.int64))
        new = pd.concat(list(batches))[[order, *values]].drop_duplicates(order).sort_values(order)
        if len(tail):
            new = new[new[order] > orders[-1]]
        rows = pd.concat([tail, new], ignore_index=True) if len(tail) else new.reset_index(drop=True)
        out = kernel(rows).iloc[len(tail):]
        out.insert(0, order, rows[order].iloc[len(tail):])
        out.insert(0, key, group[0])
        last = rows.iloc[max(0, len(rows) - halo):]
        state.update(([int(x) for x in last[order]], [float(x) for x in last[values].to_numpy(float).ravel()]))
        yield out[[key, order, *names]]

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, {order} {order_type}, {added}", "orders array<bigint>, flat array<double>", "append", GroupStateTimeout.NoTimeout)


def to_table(df: DataFrame, spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """Run a stream over what is there and return what it has written. Output and checkpoint lie in the shared folder.

    With a `path` of an earlier run it goes on where that ended: state comes from its checkpoint, and the sink leaves out
    batches that it has already, so a run that is stopped at any moment and started again writes each row once.
    """
    path = path or f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    run = df.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def to_batches(df: DataFrame, spark: SparkSession, name: str, encode) -> list:
    """Run a stream over what is there; `encode(rows, batch_id)` gets every micro-batch, as a sink to a wire would."""
    out: list = []
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.writeStream.foreachBatch(lambda b, i: out.append(encode(b, i))).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    return out
