"""The scan of order events: record, symbol and session filters, null prices, snapshot times, fast-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.scalar import wall_clock_ns
from tidebook.functions.totals import running_totals
from tidebook.schemas import FLAG_SNAPSHOT, NO_PRICE

#: Fixed value: the record type of order events.
RTYPE = 160


def session(day, product: str):
    """``(start, end)`` in UTC ns: futures have the UTC day, equities 02:00 to 16:00 in New York."""
    day = F.lit(day).cast("date") if isinstance(day, str) else day
    if product.startswith("future"):
        return wall_clock_ns(day, F.lit("00:00:00"), "UTC"), wall_clock_ns(F.date_add(day, 1), F.lit("00:00:00"), "UTC")
    return wall_clock_ns(day, F.lit("02:00:00")), wall_clock_ns(day, F.lit("16:00:00"))


def scan(records: DataFrame, symbols: DataFrame | None, symbol: str, product: str, day: str, skip_to_ns: int = 0) -> DataFrame:
    """Order events of a symbol and session from raw records.

    `records` has ``seq, rtype, instrument_id, ts_ns, action, side, price_int, size, order_id, flags``, `symbols`
    maps ``instrument_id`` to ``raw_symbol`` (unknown ids pass; spreads of futures go). Clears and snapshot rows
    pass the time filters. A missing price drops additions and changes and is 0 elsewhere. Snapshot rows take
    the time of the snapshot's clear.
    """
    df = records.filter(F.col("rtype") == RTYPE)
    if symbols is not None:
        named = df.join(symbols.select("instrument_id", "raw_symbol"), "instrument_id", "left")
        wanted = F.col("raw_symbol").isNull() | F.col("raw_symbol").startswith(symbol)
        if product.startswith("future"):
            wanted = wanted & (F.col("raw_symbol").isNull() | ~F.contains("raw_symbol", F.lit("-")))
        df = named.filter(wanted).drop("raw_symbol")
    snapshot, clear = F.col("flags").bitwiseAND(FLAG_SNAPSHOT) != 0, F.col("action") == "R"
    start, end = session(day, product)
    exempt = snapshot | clear
    df = df.filter(exempt | (F.col("ts_ns") >= start) & (F.col("ts_ns") < end))
    missing = F.col("price_int").isNull() | (F.col("price_int") == NO_PRICE)
    df = df.filter(~(missing & F.col("action").isin("A", "M"))).withColumn("price_int", F.when(missing, 0).otherwise(F.col("price_int")))
    df = df.filter(exempt | (F.col("ts_ns") >= skip_to_ns))
    return snapshot_times(df).select("seq", "ts_ns", "action", "side", "price_int", "size", "order_id", "flags")


def snapshot_times(df: DataFrame) -> DataFrame:
    """Flagged rows take the time of the last flagged clear before them."""
    snapshot = F.col("flags").bitwiseAND(FLAG_SNAPSHOT) != 0
    opens = (snapshot & (F.col("action") == "R")).cast("long")
    df = running_totals(df.withColumn("_o", opens), [], "seq", {"_n": "_o"}, chunk=1 << 20)
    at = df.filter("_o = 1").select("_n", F.col("ts_ns").alias("_at"))
    df = df.join(at, "_n", "left")
    return df.withColumn("ts_ns", F.when(snapshot & F.col("_at").isNotNull(), F.col("_at")).otherwise(F.col("ts_ns"))).drop("_o", "_n", "_at")


def option_symbols(definitions: DataFrame, underlying: str, day: str, zero_dte: bool = False) -> DataFrame:
    """Symbols of calls and puts on an underlying of the session's expiry, or else of the next one."""
    d = definitions.filter(F.col("instrument_class").isin("C", "P") & (F.col("underlying") == underlying))
    if zero_dte:
        d = d.filter(F.col("expiry") == F.lit(day).cast("date"))
    else:
        d = d.filter(F.col("expiry") >= F.lit(day).cast("date"))
        d = d.join(F.broadcast(d.agg(F.min("expiry").alias("next"))), F.col("expiry") == F.col("next"))  # one row
    return d.select("raw_symbol").distinct().orderBy("raw_symbol")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of equal keys, by seq."""
    rank = Window.partitionBy(*keys).orderBy("seq")
    return events.withColumn("_r", F.row_number().over(rank)).filter("_r = 1").drop("_r")
