"""Data-quality checks: every rule is a counted violation in one aggregation over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.chunks import over_chunks


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, n_bad, n_rows``, one row per rule; a rule is what a bad row looks like."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(r).alias(name) for name, r in rules.items()])
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n_bad")) for name in rules])
    return counts.select("n", F.explode(each).alias("r")).select("r.rule", "r.n_bad", F.col("n").alias("n_rows"))


def finite_rules(columns: list[str]) -> dict[str, Column]:
    return {f"finite_{c}": F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in columns}


def header_checks(bins: DataFrame) -> DataFrame:
    """Of bin headers: sequence and time go up by one step, the spread isn't negative, counts and prices aren't either."""
    def build(df: DataFrame, axis) -> DataFrame:
        return df.withColumns({"_b": F.lag("bin_seq").over(axis.ordered), "_t": F.lag("ts_ns").over(axis.ordered)})

    df = over_chunks(bins, [], "bin_seq", 1, build)
    return violations(df, {
        "sequence": F.col("_b").isNotNull() & (F.col("bin_seq") != F.col("_b") + 1), "time": F.col("ts_ns") <= F.col("_t"), "spread": F.col("best_ask") < F.col("best_bid"),
        "count": F.col("bin_event_count") < 0, "price": F.col("mid_price") < 0, "empty_price": (F.col("bin_event_count") == 0) & (F.col("mid_price") != 0),
    })


def gold_checks(gold: DataFrame) -> DataFrame:
    """Of a gold grid: scores within [-1, 1], states in their ranges, all numbers finite."""
    return violations(gold, {"score": F.abs("flow_score") > 1, "flow_state": ~F.col("flow_state_code").isin(-1, 0, 1), "state5": ~F.col("state5_code").between(-2, 2), **finite_rules(["pressure_variant", "vacuum_variant", "composite", "composite_d1", "composite_d2", "composite_d3", "flow_score"])})


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """``n_repeated``: keys with more than one row."""
    return df.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("n_repeated"))


def rate_checks(runs: DataFrame) -> DataFrame:
    """Of run rows: the three rates sum to 1, counts add up."""
    total = F.col("tp_rate") + F.col("sl_rate") + F.col("timeout_rate")
    return violations(runs, {"rates": (F.col("n_signals") > 0) & (F.abs(total - 1) > 1e-6), "counts": F.col("n_up") + F.col("n_down") != F.col("n_signals"), "no_rates": (F.col("n_signals") > 0) & total.isNull()})


def active(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows in which some of the columns isn't zero; null counts as zero."""
    return df.filter(sum((F.abs(F.coalesce(F.col(c), F.lit(0))) for c in columns), F.lit(0.0)) > 0)


def between(df: DataFrame, start: int, end: int, time: str = "ts_ns") -> DataFrame:
    """The rows of a time window, its end excluded; an error if there are none."""
    rows = df.filter((F.col(time) >= start) & (F.col(time) < end))
    if rows.isEmpty():
        raise ValueError(f"no rows from {start} to {end}")
    return rows


def dense(df: DataFrame, n_cells: int) -> DataFrame:
    """The grid as it is; reading a bin that hasn't exactly `n_cells` rows is an error."""
    counts = df.groupBy("bin_seq").agg(F.count("*").alias("_n"))
    message = F.concat(F.lit("bin "), F.col("bin_seq").cast("string"), F.lit(" has "), F.col("_n").cast("string"), F.lit(f" cells instead of {n_cells}"))
    checked = counts.filter(F.when(F.col("_n") != n_cells, F.raise_error(message).cast("boolean")).otherwise(True))
    return df.join(checked.drop("_n"), "bin_seq")
