"""Datasets on storage: listing, registry, pruned scans, copies, manifests and the feature-store layout.

Paths go through Hadoop's file systems, so they may be local, HDFS or object stores.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def symbol_path(spark: SparkSession, root: str, symbol: str) -> str:
    """The folder ``symbol=X`` of the longest prefix of a symbol that exists: a contract falls back to its root."""
    there = {c.removeprefix("symbol=") for c in children(spark, root) if c.startswith("symbol=")}
    for n in range(len(symbol), 0, -1):
        if symbol[:n] in there:
            return f"{root}/symbol={symbol[:n]}"
    raise FileNotFoundError(f"no prefix of {symbol} under {root}")


def dataset_path(spark: SparkSession, curated: str, generated: str, dataset_id: str) -> str:
    """Curated datasets come first."""
    for root in (curated, generated):
        if exists(spark, f"{root}/{dataset_id}"):
            return f"{root}/{dataset_id}"
    raise FileNotFoundError(dataset_id)


def dataset_ids(spark: SparkSession, curated: str, generated: str) -> list[str]:
    return sorted({*children(spark, curated), *children(spark, generated)})


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the columns asked for; a missing one is an error before any data is read."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.schema.names]
    if missing:
        raise KeyError(f"{path} lacks columns {missing}")
    return df.select(*columns)


def publish(df: DataFrame, path: str, drop_prefixes: tuple[str, ...] = ("proj_score_h", "flow_"), drop: tuple[str, ...] = ()) -> DataFrame:
    """Write a copy without model columns, zstd-compressed; returns what was written."""
    kept = [c for c in df.columns if not c.startswith(drop_prefixes) and c not in drop]
    df.select(*kept).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, sha256`` of every file below a path, hashed where the data is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, path: str, config: dict) -> None:
    """``_manifest.json`` beside the data; names with an underscore aren't data to Spark."""
    fs, p = _fs(spark, f"{path}/_manifest.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(config, sort_keys=True).encode()))
    out.close()


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, f"{path}/_manifest.json")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def materialised(spark: SparkSession, path: str, config: dict, build) -> DataFrame:
    """The dataset at a path if its manifest has this configuration; else `build()` is written there."""
    if read_manifest(spark, path) != config:
        build().write.mode("overwrite").parquet(path)
        write_manifest(spark, path, config)
    return spark.read.parquet(path)


def feature_view(grid: DataFrame, bins: DataFrame, dataset_id: str) -> DataFrame:
    """The grid with ``dataset_id, event_timestamp`` and the composite ``entity_key`` of a feature store."""
    times = bins.select("bin_seq", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("long")).alias("event_timestamp"))
    key = F.concat_ws("__", F.lit(dataset_id), F.col("bin_seq").cast("string"), F.col("k").cast("string"))
    return grid.join(times, "bin_seq").withColumns({"dataset_id": F.lit(dataset_id), "entity_key": key})


def entity_frame(bins: DataFrame, radius: int, dataset_id: str) -> DataFrame:
    """``bin_seq, k, entity_key`` for every bin and every level."""
    rows = bins.select("bin_seq", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("k"))
    return rows.withColumn("entity_key", F.concat_ws("__", F.lit(dataset_id), F.col("bin_seq").cast("string"), F.col("k").cast("string")))


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: what uses it several times computes it once, and a lost executor costs no recomputation."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
