"""Where a signal sees the spot some bins ahead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions import scalar

#: Spread in rows, and opacity, by bins ahead; half the width of the band in rows.
SPREAD = [(1, 6), (2, 10), (4, 16), (8, 24)]
ALPHA = [(1, 0.5), (2, 0.4), (4, 0.3), (8, 0.2)]
HALF_WIDTH = 4


def projected(rows: DataFrame, spot: str, signal: str, horizons: Sequence[int] = (1, 2, 3, 4), scale: float = 1.0) -> DataFrame:
    """Every row once a horizon, with ``horizon, centre, low, high, alpha``: the signal moves the spot by its share of a spread.

    A positive signal lowers the row number. Horizons are whole bins; those below 1 are left out, repeated ones count once.
    A null spot or signal gives null places.
    """
    ahead = rows.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in sorted({h for h in horizons if h > 0})])))
    spread = F.greatest(F.lit(2.0), F.floor(scalar.piecewise(F.col("horizon"), SPREAD) + 0.5))
    alpha = F.least(F.greatest(scalar.piecewise(F.col("horizon"), ALPHA), F.lit(0.1)), F.lit(0.6))
    placed = ahead.withColumn("centre", F.col(spot) - F.lit(scale) * F.col(signal) * spread)
    return placed.withColumn("low", F.col("centre") - HALF_WIDTH).withColumn("high", F.col("centre") + HALF_WIDTH).withColumn("alpha", alpha)
