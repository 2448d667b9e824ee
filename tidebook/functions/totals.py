"""Running totals over series of any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.chunks import CHUNK


def running_totals(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], chunk: int = CHUNK, ties: Sequence[str] = (), following: str | None = None) -> DataFrame:
    """Inclusive running sums ``{new column: summed column}`` by an integer order (`ties` break equals).

    Sums are taken by chunk of the order first; only the chunk totals, one row per key and chunk, meet in a
    window over a whole key. Then the rows of each chunk start from their chunk's offset. `following` adds a column
    of that name: the order of the key's next row, null for the last; a chunk's last row takes the next chunk's first.
    """
    df = df.withColumn("_c", F.floor(F.col(order) / chunk))
    along = Window.partitionBy(*keys).orderBy("_c")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_c").agg(*[F.sum(x).alias(f"_t_{n}") for n, x in values.items()], *([F.min(order).alias("_first")] if following else []))
    after = [F.lead("_first").over(along).alias("_after")] if following else []
    offsets = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_c").alias("_k_c"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values], *after)
    same = F.col("_c") == F.col("_k_c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_c").orderBy(order, *ties)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(offsets, same)
    found = {n: F.col(f"_o_{n}") + F.sum(x).over(so_far) for n, x in values.items()}
    if following:
        found[following] = F.coalesce(F.lead(order).over(inside), F.col("_after"))
    return out.withColumns(found).drop("_c", "_k_c", "_after", *[f"_k_{k}" for k in keys], *[f"_o_{n}" for n in values])
