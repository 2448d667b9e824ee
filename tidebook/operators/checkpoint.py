"""Checkpoints of a book: resting orders with a fingerprint of what was replayed, and replays that go on from there.

A restored replay starts from one addition per resting order, all with the number of the last event that the checkpoint has
seen. What follows is the same plan as that of a whole replay, so changes after the checkpoint are the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import book
from tidebook.schemas import FLAG_SNAPSHOT
from tidebook.sources.files import stored

COLUMNS = ["seq", "ts_ns", "action", "side", "tick", "size", "order_id", "flags"]
ORDERS = "order_id long, side string, tick int, qty long"
MANIFEST = "source string, day string, last_seq long, last_ns long, n_orders long, digest string, best_bid int, best_ask int, valid boolean"


@dataclass(frozen=True)
class Checkpoint:
    """What was replayed (source, day, up to last_seq), its resting orders, best prices, and whether the book was valid."""

    source: str
    day: str
    last_seq: int
    last_ns: int
    best_bid: int | None
    best_ask: int | None
    valid: bool
    orders: DataFrame


def _summary(orders: DataFrame) -> dict:
    """Number, digest and best prices of resting orders; the digest doesn't depend on the order of rows."""
    row = F.xxhash64("order_id", "side", "tick", "qty").cast("decimal(38,0)")
    side = lambda s: F.when(F.col("side") == s, F.col("tick"))
    return orders.agg(F.count("*").alias("n_orders"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest"), F.max(side("B")).cast("int").alias("best_bid"), F.min(side("A")).cast("int").alias("best_ask")).first().asDict()


def valid_after(events: DataFrame, start: Checkpoint | None, few: list[int] | None = None) -> bool:
    """Whether the book is valid after the events: not inside a snapshot, be it one that the checkpoint left open.

    `few` are the numbers of the clearing events where they are known.
    """
    if (events.filter("action = 'R'").isEmpty() if few is None else not few) and (start is None or start.valid):
        return True
    rows = seeded(events, start).select("seq", "action", "flags")
    if start is not None:
        rows = rows.filter(F.col("seq") > start.last_seq)
        if not start.valid:
            rows = rows.unionByName(events.sparkSession.createDataFrame([(start.last_seq, "R", FLAG_SNAPSHOT)], "seq long, action string, flags int"))
    return book.book_valid(rows).agg(F.max_by("valid", "seq")).first()[0]


def save(events: DataFrame, path: str, source: str, day: str, start: Checkpoint | None = None) -> Checkpoint:
    """Write the checkpoint after `events`, which continue `start` (kept elsewhere) if there is one. What was at `path` is replaced."""
    return advance(events, path, source, day, start)[0]


def advance(events: DataFrame, path: str, source: str, day: str, start: Checkpoint | None = None) -> tuple[Checkpoint, DataFrame]:
    """`save`, and what `changes` returns. Orders go through their windows once, and both are read from their states."""
    spark, known = events.sparkSession, seeded(events, start)
    few = book.clears(known)
    known = stored(book.order_states(book.with_epochs(known, few)), "order-states")
    book.state_resting(known, known if few is None else few).write.mode("overwrite").parquet(f"{path}/orders")
    orders = spark.read.schema(ORDERS).parquet(f"{path}/orders")
    last = known.agg(F.max(F.struct("seq", "ts_ns")).alias("z")).select("z.*").first()
    seq, ns = (last["seq"], last["ts_ns"]) if last["seq"] is not None else (start.last_seq, start.last_ns) if start else (-1, 0)
    found, valid = _summary(orders), valid_after(events, start, few)
    row = (source, day, seq, ns, found["n_orders"], found["digest"], found["best_bid"], found["best_ask"], valid)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    moved = book.state_changes(known, few)
    return Checkpoint(source, day, seq, ns, found["best_bid"], found["best_ask"], valid, orders), moved if start is None else moved.filter(F.col("seq") > start.last_seq)


def load(spark: SparkSession, path: str, source: str, day: str, last_seq: int | None = None) -> Checkpoint:
    """The checkpoint at `path`. It is an error if it is of another source or day, of another event (`last_seq`, if given),
    or if its orders aren't those that were written."""
    try:
        row = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    except AnalysisException as e:
        raise ValueError(f"no checkpoint at {path}") from e
    orders = spark.read.schema(ORDERS).parquet(f"{path}/orders")
    for name, want in (("source", source), ("day", day), ("last_seq", last_seq)):
        if want is not None and row[name] != want:
            raise ValueError(f"the checkpoint at {path} is of {name} {row[name]}, not {want}")
    if any(row[c] != x for c, x in _summary(orders).items()):
        raise ValueError(f"the orders at {path} aren't those of its manifest")
    return Checkpoint(row["source"], row["day"], row["last_seq"], row["last_ns"], row["best_bid"], row["best_ask"], row["valid"], orders)


def seeded(events: DataFrame, start: Checkpoint | None) -> DataFrame:
    """The events after a checkpoint, and its orders as additions before them; without a checkpoint all events."""
    if start is None:
        return events.select(*COLUMNS)
    seeds = start.orders.select(F.lit(start.last_seq).cast("long").alias("seq"), F.lit(start.last_ns).cast("long").alias("ts_ns"), F.lit("A").alias("action"), "side", "tick", F.col("qty").alias("size"), "order_id", F.lit(0).alias("flags"))
    return seeds.unionByName(events.select(*COLUMNS).filter(F.col("seq") > start.last_seq))


def changes(events: DataFrame, start: Checkpoint | None, within: Sequence[str] = ()) -> DataFrame:
    """What `book.changes` of the whole replay has after the checkpoint."""
    if start is None:
        return book.changes(events, within=within)
    return book.changes(seeded(events, start)).filter(F.col("seq") > start.last_seq)


def depth(start: Checkpoint) -> DataFrame:
    """``side, tick, depth`` of a checkpoint's book."""
    return start.orders.groupBy("side", "tick").agg(F.sum("qty").alias("depth"))
