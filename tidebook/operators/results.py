"""Experiment results: an append-only store, best rows, ranking and filters over runs and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Metrics for which less is better.
LOWER_IS_BETTER = {"sl_rate", "timeout_rate", "median_time_to_outcome_ms"}


def append(df: DataFrame, path: str) -> None:
    """Add rows to a store; readers merge schemas, so later runs may have more columns."""
    df.write.mode("append").option("compression", "zstd").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def best_per_run(runs: DataFrame, metric: str = "tp_rate", min_signals: int = 5) -> DataFrame:
    """Of each run the row with the largest metric among those with enough signals; ties go to the lowest threshold."""
    rank = Window.partitionBy("run_id").orderBy(F.col(metric).desc_nulls_last(), "threshold")
    supported = runs.filter((F.col("n_signals") >= min_signals) & F.col(metric).isNotNull())
    return supported.withColumn("_r", F.row_number().over(rank)).filter("_r = 1").drop("_r")


def with_meta(runs: DataFrame, meta: DataFrame, columns: list[str]) -> DataFrame:
    """Runs with those columns of their metadata that are there."""
    there = [c for c in columns if c in meta.columns and c not in runs.columns]
    return runs.join(meta.select("run_id", *there), "run_id")


def ranked(rows: DataFrame, metric: str, top: int = 50) -> DataFrame:
    """The best rows by a metric, in its direction, nulls last, with their ``rank``."""
    by = F.col(metric).asc_nulls_last() if metric in LOWER_IS_BETTER else F.col(metric).desc_nulls_last()
    order = [by, F.col("run_id").asc(), F.col("threshold").asc()]
    first = rows.orderBy(*order).limit(top)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most `top` rows


def filtered(rows: DataFrame, **equal) -> DataFrame:
    """Rows equal in the given columns; columns that aren't there don't filter."""
    for name, value in equal.items():
        if name in rows.columns:
            rows = rows.filter(F.col(name) == value)
    return rows


def tracked_best(runs: DataFrame, metric: str = "tp_rate") -> DataFrame:
    """One row per run: its best by the metric, null and NaN counting as least."""
    value = F.coalesce(F.nanvl(F.col(metric), F.lit(float("-inf"))), F.lit(float("-inf")))
    whole = F.struct(value.alias("_v"), (-F.col("threshold")).alias("_t"), F.struct(*runs.columns).alias("row"))
    return runs.groupBy("run_id").agg(F.max(whole).alias("m")).select("m.row.*")


def sensitivity(runs: DataFrame, meta: DataFrame, parameter: str) -> DataFrame:
    """``value, tp_rate, n_signals``: mean rate and signals of the runs by a value of their JSON parameters."""
    value = F.get_json_object("signal_params_json", f"$.{parameter}").cast("double")
    values = meta.select("run_id", value.alias("value")).filter("value is not null")
    return runs.join(values, "run_id").groupBy("value").agg(F.avg("tp_rate").alias("tp_rate"), F.sum("n_signals").alias("n_signals"))


def union_rows(*frames: DataFrame) -> DataFrame:
    """All rows of frames whose columns may differ."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def detail(runs: DataFrame, meta: DataFrame, run_id: str, parameters: list[str]) -> DataFrame:
    """The rows of one run with its metadata and the named JSON parameters; NaN is null, as is a parameter that isn't there."""
    named = [F.get_json_object("signal_params_json", f"$.{p}").cast("double").alias(p) for p in parameters]
    kinds = dict(runs.dtypes)
    rows = runs.filter(F.col("run_id") == run_id).select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if kinds[c] == "double" else F.col(c) for c in runs.columns])
    return meta.filter(F.col("run_id") == run_id).select("run_id", "signal_name", *named).join(rows, "run_id")
