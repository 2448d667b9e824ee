"""Time windows over series of any length, in chunks with a halo.

`Window.partitionBy("k")` puts the whole history of a price level into one task, and a series without a
level into a single task. Every frame used here is finite and every series is dense (one row per bin), so
a series is cut into chunks of bins and each chunk gets copies of the last `halo` bins before it (and the
first `ahead` bins after it). Windows then partition by level and chunk: tasks stay bounded however long
the history is, for a shuffle of ``(chunk + halo) / chunk`` times the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 4096


@dataclass(frozen=True)
class Axis:
    """The windows of one chunk. Row numbers come from the dense order column, so heads are recognised anywhere."""

    keys: tuple[str, ...]
    order: str

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_chunk").orderBy(self.order)

    def last(self, n: int) -> WindowSpec:
        """The row and the n - 1 rows before it."""
        return self.ordered.rowsBetween(-(n - 1), 0)

    def next(self, n: int) -> WindowSpec:
        """The n rows after the row."""
        return self.ordered.rowsBetween(1, n)

    @property
    def number(self):
        return F.col(self.order)


def spread(df: DataFrame, order: str, halo: int, ahead: int, chunk: int) -> DataFrame:
    """Each row once per chunk that needs it: ``_chunk``, and ``_own`` where the row belongs."""
    b = F.col(order)
    first, last = F.floor((b - ahead) / chunk), F.floor((b + halo) / chunk)
    df = df.withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return df.withColumn("_own", F.col("_chunk") == F.floor(b / chunk))


def over_chunks(df: DataFrame, keys: Sequence[str], order: str, halo: int, build: Callable[[DataFrame, Axis], DataFrame], ahead: int = 0, chunk: int = CHUNK) -> DataFrame:
    """`build` adds window columns to the chunks; the rows come back as they were, with the new columns."""
    built = build(spread(df, order, halo, ahead, chunk), Axis(tuple(keys), order))
    return built.filter("_own").drop("_own", "_chunk")


def apply_chunks(df: DataFrame, keys: Sequence[str], order: str, halo: int, kernel: Callable[[pd.DataFrame], pd.DataFrame], added: str, ahead: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Like `over_chunks` with a numpy kernel: it gets a chunk in order and returns the columns `added` (a DDL string)."""
    columns = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + added

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        out = pd.concat([pdf[columns], kernel(pdf)], axis=1)
        return out[pdf["_own"].to_numpy()]

    return spread(df, order, halo, ahead, chunk).groupBy(*keys, "_chunk").applyInPandas(run, schema)
