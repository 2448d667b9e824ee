"""Exact percentiles of series of any length by selection: counts of value ranges, of which only those with a rank are refined."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.sources.files import stored

#: Ranges that a round cuts a range into, and rows of a range from which on it isn't cut but read.
CUTS, FEW = 4096, 2048


def percentiles(df: DataFrame, value: Column, shares: Sequence[float], by: Column | None = None, cuts: int = CUTS, few: int = FEW) -> dict:
    """The percentiles of `value` for each of `shares`, with linear interpolation: ``{group: [numbers]}``, the group null without `by`.

    Nulls and NaN don't count; a group without a number isn't there. Groups are few: for each, the open ranges and a rank's
    neighbours go to the driver. The series is stored once. A round counts the rows of `cuts` equal parts of every open
    range, with their least and largest value, so a round narrows a range at least so many times, and a value that many
    rows share is found at once. So no task holds more than the counts of a round or `few` rows of each rank.
    """
    spark = df.sparkSession
    group = F.lit(None).cast("string") if by is None else by
    rows = stored(df.select(group.alias("g"), value.cast("double").alias("x")).filter("x is not null and not isnan(x)"), "series")
    kind = rows.schema["g"].dataType.simpleString()
    open_, ranks, found, counts = [], [], {}, {}
    for g, n, low, high in rows.groupBy("g").agg(F.count("*"), F.min("x"), F.max("x")).collect():
        counts[g] = n
        places = {f((n - 1) * q) for q in shares for f in (math.floor, math.ceil)}
        ranks += [(g, r) for r in places]
        if low == high:
            found |= {(g, r): low for r in places}
        else:
            open_.append((g, low, high, 0))
    near: dict[tuple, tuple] = {}
    while open_:
        ranges = F.broadcast(spark.createDataFrame(open_, f"h {kind}, low double, high double, below long"))
        wanted = F.broadcast(spark.createDataFrame([r for r in ranks if r not in found], f"h {kind}, rank long"))
        wide = F.col("high") - F.col("low")
        # the distance of the largest doubles is no number, but that of their halves is
        share = F.when(wide < float("inf"), (F.col("x") - F.col("low")) / wide).otherwise((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2))
        part = F.least(F.floor(share * cuts), F.lit(cuts - 1))
        inside = rows.join(ranges, F.col("g").eqNullSafe(F.col("h")) & F.col("x").between(F.col("low"), F.col("high"))).groupBy("g", "low", "below", part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        before = F.col("below") + F.coalesce(F.sum("n").over(Window.partitionBy("g", "low").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inside = inside.select("g", "n", "least", "most", before.alias("before"))
        hit = inside.join(wanted, F.col("g").eqNullSafe(F.col("h")) & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        again = set()
        for r in hit.select("g", "rank", "n", "least", "most", "before").collect():
            if r["least"] == r["most"]:
                found[r["g"], r["rank"]] = r["least"]
            elif r["n"] <= few:
                near[r["g"], r["least"], r["most"]] = (r["before"], [*near.get((r["g"], r["least"], r["most"]), (0, []))[1], r["rank"]])
                found[r["g"], r["rank"]] = None
            else:
                again.add((r["g"], r["least"], r["most"], r["before"]))
        open_ = list(again)
    if near:
        ranges = F.broadcast(spark.createDataFrame([(g, a, z) for g, a, z in near], f"h {kind}, low double, high double"))
        held = rows.join(ranges, F.col("g").eqNullSafe(F.col("h")) & F.col("x").between(F.col("low"), F.col("high"))).groupBy("g", "low", "high").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        for g, low, high, xs in held.collect():
            before, places = near[g, low, high]
            found |= {(g, r): xs[r - before] for r in places}

    def at(g, q: float) -> float:
        place = (counts[g] - 1) * q
        low, high = math.floor(place), math.ceil(place)
        a, z = found[g, low], found[g, high]
        return a if low == high or a == z else (high - place) * a + (place - low) * z

    return {g: [at(g, q) for q in shares] for g in counts}
