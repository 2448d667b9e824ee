"""Latency records of bins: JSON lines on storage, and percentiles of the last records at every so many of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebook.functions.chunks import over_chunks

SAMPLE, EVERY = 200, 50
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def in_window(records: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Records whose bin ``bin_start_ns, bin_end_ns`` overlaps the window; an open side doesn't bound it."""
    if start_ns is not None:
        records = records.filter(F.col("bin_end_ns") > start_ns)
    return records.filter(F.col("bin_start_ns") < end_ns) if end_ns is not None else records


def to_jsonl(records: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Append records as JSON lines; a stream goes on with the files until it is stopped."""
    if records.isStreaming:
        return records.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
    records.write.mode("append").json(path)
    return None


def summaries(records: DataFrame, value: str, every: int = EVERY, sample: int = SAMPLE, number: str = "number") -> DataFrame:
    """``number, n, p50, p95, p99`` of the last `sample` records at every `every`-th one; `number` counts from 0."""
    def build(df: DataFrame, axis) -> DataFrame:
        last = axis.last(sample)
        return df.withColumns({"n": F.count(value).over(last), "_sorted": F.when((F.col(number) + 1) % every == 0, F.array_sort(F.collect_list(value).over(last)))})

    df = over_chunks(records.select(number, value), [], number, sample, build).filter((F.col(number) + 1) % every == 0)

    def at(q: float):
        place = (F.size("_sorted") - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        a, b = F.get("_sorted", low), F.get("_sorted", F.least(low + 1, F.size("_sorted") - 1))
        return a + (b - a) * (place - low)

    return df.select(number, "n", *[at(q).alias(name) for name, q in PERCENTILES.items()])
