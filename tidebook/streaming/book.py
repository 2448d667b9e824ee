"""The order book of a stream: each micro-batch goes on from the checkpoint that the one before has left.

State is a table of resting orders per micro-batch, not a state store: a cleared book touches all orders at once, which no
keyed state can see. A batch reads the state of the batch before, writes its changes and its own state, each under its
number; a batch that is run again after a failure replaces what it had written, so every change is there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebook.operators import checkpoint

CHANGES = "seq long, ts_ns long, side string, tick int, d_depth long, add long, pull long, fill long, touched boolean, batch long"


def replayed(stream: DataFrame, spark: SparkSession, path: str, source: str, day: str) -> DataFrame:
    """Run a stream of order events over what is there; all changes so far: the columns of `book.changes`, and ``batch``.

    Batches come in the order of `seq`, in any cut and in any order inside a batch; events that aren't later than a batch
    before are left out. Called again with the same `path`, the stream goes on where it ended.
    """

    def step(batch: DataFrame, number: int) -> None:
        start = checkpoint.load(spark, f"{path}/book/{number - 1}", source, day) if number else None
        changes = checkpoint.advance(batch, f"{path}/book/{number}", source, day, start)[1]
        changes.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    run = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(CHANGES).parquet(f"{path}/changes")
