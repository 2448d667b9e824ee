"""Parameter sweeps: cartesian products of axes as tables of runs with stable ids."""

from __future__ import annotations

from itertools import islice, product

from pyspark.sql import DataFrame, SparkSession

from tidebook.functions.scalar import config_hash


def runs(axes: dict[str, list], most: int | None = None) -> list[dict]:
    """All combinations, in the order of the axes, the first `most` of them; `run_id` is a hash of the values."""
    combined = (dict(zip(axes, values, strict=True)) for values in product(*axes.values()))
    return [x | {"run_id": config_hash(x, 16)} for x in islice(combined, most)]


def table(spark: SparkSession, axes: dict[str, list], most: int | None = None) -> DataFrame:
    return spark.createDataFrame(runs(axes, most))


def required_columns(names: list[str]) -> list[str]:
    """Union of the columns of signals, so that a dataset is read once for all runs over it."""
    from tidebook.operators.signals import REGISTRY

    return sorted({c for n in names for c in REGISTRY[n].columns})
