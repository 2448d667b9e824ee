"""Joins that Spark's join operators don't name: as-of in both directions, snapshot differences, dense scatter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], block: int, within: int | None = None, strict: bool = False) -> DataFrame:
    """Each row of `left` with `columns` of the last row of `right` that has its keys and isn't later.

    `within` bounds the age of what is taken, `strict` wants it earlier. Rows meet in blocks of time. A left row
    whose block has no earlier right row takes the last one of the blocks before, which is a window over one row
    per key and block. Ties of `right` in time go to the largest columns.
    """
    block_of = lambda x: F.floor(F.col(x) / block)
    lefts = left.select(*left.columns, block_of(left_time).alias("_b"), F.lit(0 if strict else 1).alias("_side"), F.col(left_time).alias("_t"), F.lit(True).alias("_mine"))
    value = F.struct(F.col(right_time).alias("_rt"), *[F.col(c) for c in columns])
    r = right.select(*keys, value.alias("_v"), F.col(right_time).alias("_t"), block_of(right_time).alias("_b"))
    carried = r.groupBy(*keys, "_b").agg(F.max("_v").alias("_last"))
    # the last value of earlier blocks, for every block that a left row is in
    asked = lefts.select(*keys, "_b").distinct().withColumn("_last", F.lit(None).cast(carried.schema["_last"].dataType))
    both = carried.unionByName(asked).groupBy(*keys, "_b").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = both.select(*keys, "_b", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    rows = lefts.withColumn("_v", F.lit(None).cast(r.schema["_v"].dataType)).unionByName(r.withColumn("_side", F.lit(1 if strict else 0)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_b").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_near", F.last("_v", ignorenulls=True).over(inside)).filter("_mine").join(carry, [*keys, "_b"], "left")
    hit = F.coalesce("_near", "_carry")
    if within is not None:
        hit = F.when(F.col(left_time) - hit["_rt"] <= within, hit)
    return found.select(*left.columns, *[hit[c].alias(f"{c}_at") for c in columns])


def ahead(df: DataFrame, keys: Sequence[str], time: str, by: int, columns: Sequence[str], block: int) -> DataFrame:
    """Each row with `columns` of the first row that is at least `by` later; null where there is none.

    The mirror image of `as_of`: rows meet in the block of the time asked for, and where that has nothing later
    the first row of the blocks behind it counts.
    """
    b = F.floor(F.col(time) / block)
    target = F.col(time) + by
    asks = df.select(*df.columns, target.alias("_t"), F.floor(target / block).alias("_b"))
    value = F.struct(F.col(time).alias("_rt"), *[F.col(c) for c in columns])
    r = df.select(*keys, value.alias("_v"), F.col(time).alias("_t"), b.alias("_b"))
    firsts = r.groupBy(*keys, "_b").agg(F.min("_v").alias("_first"))
    asked = asks.select(*keys, "_b").distinct().withColumn("_first", F.lit(None).cast(firsts.schema["_first"].dataType))
    both = firsts.unionByName(asked).groupBy(*keys, "_b").agg(F.min("_first").alias("_first"))
    after = Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    carry = both.select(*keys, "_b", F.first("_first", ignorenulls=True).over(after).alias("_carry"))
    rows = asks.withColumn("_v", F.lit(None).cast(r.schema["_v"].dataType)).unionByName(r, allowMissingColumns=True).withColumn("_side", F.col("_v").isNotNull().cast("int"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_t", "_side", "_v").rowsBetween(1, Window.unboundedFollowing)
    found = rows.withColumn("_near", F.first("_v", ignorenulls=True).over(inside)).filter("_side = 0").join(carry, [*keys, "_b"], "left")
    hit = F.coalesce("_near", "_carry")
    return found.select(*df.columns, *[hit[c].alias(f"{c}_ahead") for c in columns])


def diff(old: DataFrame, new: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """``key, status`` and both sides' values: added, removed, changed or unchanged, nulls being equal to nulls."""
    a = old.select(F.col(key).alias("_ka"), *[F.col(c).alias(f"{c}_old") for c in values])
    b = new.select(F.col(key).alias("_kb"), *[F.col(c).alias(f"{c}_new") for c in values])
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"{c}_old").eqNullSafe(F.col(f"{c}_new"))
    status = F.when(F.col("_ka").isNull(), "added").when(F.col("_kb").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return a.join(b, F.col("_ka") == F.col("_kb"), "full").select(F.coalesce("_ka", "_kb").alias(key), status.alias("status"), *[c for v in values for c in (f"{v}_old", f"{v}_new")])


def dense(df: DataFrame, row: str, position: str, radius: int, value: str | Column) -> DataFrame:
    """``row, values``: an array of 2 * radius + 1 numbers per row, 0 where a position is absent; positions beyond are dropped."""
    x = F.col(value) if isinstance(value, str) else value
    near = df.filter(F.col(position).between(-radius, radius))
    entries = near.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.col(position).cast("int"), x.cast("double")))).alias("_m"))
    return entries.select(row, F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0))).alias("values"))


def interpolated(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], block: int) -> DataFrame:
    """Each row of `left` with `columns` read off the line between its two neighbours in time in `right`, as doubles.

    A row at the very time of a neighbour has its values. Beyond the first and the last row of `right`, or beside a
    null, the result is null. The neighbour behind is found as the one before is, with time running backwards.
    """
    values = right.select(*keys, *[F.col(c).cast("double").alias(f"_{c}") for c in columns], F.col(right_time).alias("_at"), (-F.col(right_time)).alias("_back"))
    asked, taken = left.withColumn("_ask", -F.col(left_time)), ["_at", *[f"_{c}" for c in columns]]

    def beside(df: DataFrame, ask: str, time: str, name: str) -> DataFrame:
        found = as_of(df, values, keys, ask, time, taken, block)
        return found.withColumnsRenamed({f"{c}_at": f"{c}_{name}" for c in taken})

    both = beside(beside(asked, left_time, "_at", "lo"), "_ask", "_back", "hi")
    share = (F.col(left_time) - F.col("_at_lo")) / (F.col("_at_hi") - F.col("_at_lo"))
    line = lambda c: F.when(F.col("_at_lo") == F.col("_at_hi"), F.col(f"_{c}_lo")).otherwise(F.col(f"_{c}_lo") + (F.col(f"_{c}_hi") - F.col(f"_{c}_lo")) * share)
    return both.select(*left.columns, *[line(c).alias(f"{c}_at") for c in columns])
