"""Keyed streaming state against runs over the whole series, in any cut of the stream."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.operators import gold, signals
from tidebook.streaming import bins as stream
from tidebook.streaming import runtime


def source(spark, folder, batches, schema):
    """One file a batch, each its own micro-batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/b{i}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return files.parquet(f"file://{folder}")


def test_scores_of_a_stream_are_those_of_the_series(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, b, *(float(x) for x in rng.normal(size=3))) for b in range(500) for k in (-1, 0)]
    schema = "k int, bin_seq bigint, composite_d1 double, composite_d2 double, composite_d3 double"
    # the last batch comes twice
    cuts = [rows[:3], rows[3:401], rows[401:], rows[401:]]
    df = source(spark, tmp_path, cuts, schema)
    values = schema.replace(" double", "").split(", ")[2:]
    out = stream.carried(df, "k", "bin_seq", values, gold.DEFAULT.z_window, gold.score_kernel(), "flow_score double, flow_state_code tinyint")
    got = sorted(map(tuple, stream.to_table(out, spark, "test-scores").collect()))
    whole = gold.scored(spark.createDataFrame(rows, schema)).select("k", "bin_seq", "flow_score", "flow_state_code")
    expected = sorted(map(tuple, whole.collect()))
    assert [x[:2] for x in got] == [x[:2] for x in expected]
    assert np.abs([x[2] - y[2] for x, y in zip(got, expected, strict=True)]).max() < 1e-12
    assert any(x[2] for x in got)


ROWS = [(1, 5, 5, 10), (1, 7, 7, None), (2, 8, 8, 4), (1, 38, 38, 20), (None, None, 40, None), (1, 61, 61, 1), (1, 3, 62, 99), (1, 58, 63, 7), (1, 75, 75, 2), (3, 76, 76, 5)]
#: Bins of 10, closed 5 after their end: the 99 came in too late, the 7 in time.
SUMS = {(1, 0): (2, 10), (1, 3): (1, 20), (1, 5): (1, 7), (1, 6): (1, 1), (1, 7): (1, 2), (2, 0): (1, 4), (3, 7): (1, 5)}


def filled_source(spark, folder, batches):
    schema = "k int, at_us bigint, seen_us bigint, cents bigint"
    return source(spark, folder, batches, schema).withColumn("seen", F.timestamp_micros("seen_us")).drop("seen_us")


def filled_of(df):
    return {(r.k, r.bin_seq): (r.n, r.total, r.mass) for r in df.collect()}


@pytest.mark.parametrize("cuts", [[0, 10], list(range(11)), [0, 4, 10], [0, 6, 7, 10]])
def test_filled_bins(spark, tmp_path, cuts):
    """Wherever the stream is cut: silent levels, late rows and the last, partial bins, with the clock in milliseconds."""
    unit = 1000
    rows = [(k, None if at is None else at * unit, seen * unit, c) for k, at, seen, c in ROWS]
    df = filled_source(spark, tmp_path / "in", [rows[a:z] for a, z in zip(cuts, cuts[1:], strict=False)])
    path = f"file://{tmp_path}/out"
    written = stream.to_table(stream.filled(df, 10 * unit, 5.0, 1, 5 * unit), spark, "test-filled", path)
    got, rest = filled_of(written), filled_of(stream.remaining(spark, f"{path}/state", 7, 5.0, 1))
    assert not got.keys() & rest.keys()
    got |= rest
    want, decay = {}, math.exp(-1 / 5)
    for k, first in ((1, 0), (2, 0), (3, 7)):
        mass = 0.0
        for b in range(first, 8):
            n, total = SUMS.get((k, b), (0, 0))
            mass = mass * decay + total
            if b >= 1:
                want[k, b] = (n, total, pytest.approx(mass))
    assert got == want
    if len(cuts) > 3:
        assert (2, 4) in filled_of(written)  # a level that had no row since bin 0


def test_stopped_stream_goes_on_where_it_ended(spark, tmp_path):
    rows = [(k, None if at is None else at * 1000, seen * 1000, c) for k, at, seen, c in ROWS]
    schema, path, got = "k int, at_us bigint, seen_us bigint, cents bigint", f"file://{tmp_path}/out", None
    for i in range(5):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        df = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
        df = df.withColumn("seen", F.timestamp_micros("seen_us")).drop("seen_us")
        got = stream.to_table(stream.filled(df, 10_000, 5.0, 0, 5000), spark, "test-stopped", path)
    whole = f"file://{tmp_path}/whole"
    once = stream.to_table(stream.filled(df, 10_000, 5.0, 0, 5000), spark, "test-whole", whole)
    both = [sorted(map(tuple, w.unionByName(stream.remaining(spark, f"{p}/state", 7, 5.0)).collect())) for w, p in ((got, path), (once, whole))]
    assert len(both[0]) == 17 and [r[:4] for r in both[0]] == [r[:4] for r in both[1]]


def test_long_silence_is_given_out_in_blocks(monkeypatch):
    monkeypatch.setattr(stream, "BLOCK", 7)
    keep, opened = 0.9, {3: (1, 10), 6: (2, 5), 7: (1, 1), 40: (1, 2)}
    blocks = list(stream.closed_bins(4, 3, 45, opened, 2.0, keep))
    mass, at = 2.0, 3
    for block in blocks:
        assert len(block) <= 7
        for r in block.itertuples():
            mass = mass * keep + opened.get(at, (0, 0))[1]
            assert (r.bin_seq, r.n, r.total) == (at, *opened.get(at, (0, 0))) and r.mass == pytest.approx(mass)
            at += 1
    assert at == 45 and stream.after(opened, 3, 45, 2.0, keep) == pytest.approx(mass)


PARAMS = {"exclusion": 1, "power": 0.35, "z_window": 32, "z_min": 8, "scale": 2.75, "d_weights": (1.0, 0.5, 0.25), "state_weights": (1.2, 0.8, 1.1, 0.9), "mixed_weight": 0.2, "seconds": 0.1}


@pytest.mark.parametrize("seed, cuts", [(1, [0, 3360]), (2, [0, 10, 33, 1000, 1001, 3360]), (3, [0, 3000, 3360])])
def test_derivative_runtime_is_the_batch_signal(spark, tmp_path, seed, cuts):
    """Bins that come in pieces, out of order and twice give the signal of the whole series."""
    rng = np.random.default_rng(20260220)
    rows = [("a", b, k, int(rng.integers(-2, 3))) for b in range(160) for k in range(-10, 11)]
    schema = "series string, bin_seq bigint, k int, state5_code int"
    want = signals.derivative(spark.createDataFrame(rows, schema), 10, **PARAMS).orderBy("bin_seq").collect()
    order = np.random.default_rng(seed).permutation(len(rows)) if seed > 1 else range(len(rows))
    mixed = [rows[i] for i in order]
    batches = [mixed[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
    df = source(spark, tmp_path, [*batches, batches[0][:50]], schema)
    got = stream.to_table(runtime.derivatives(df, 10, **PARAMS), spark, "test-runtime").orderBy("bin_seq").collect()
    assert [r.bin_seq for r in got] == list(range(160)) == [r.bin_seq for r in want]
    assert np.abs([a.signal - b.signal for a, b in zip(got, want, strict=True)]).max() < 1e-12
    assert [r.ready for r in got] == [b >= 7 for b in range(160)] and max(abs(r.signal) for r in got) > 0.1


def test_runtime_waits_for_whole_bins(spark, tmp_path):
    schema = "series string, bin_seq bigint, k int, state5_code int"
    rows = [("a", b, k, 2 if k else None) for b in range(4) for k in (-1, 0, 1)] + [("b", 0, k, -1) for k in (-1, 0)] + [("a", 0, 7, 1)]
    lost = [r for r in rows if r[:3] != ("a", 2, 0)]
    got = stream.to_table(runtime.derivatives(source(spark, tmp_path, [lost], schema), 1), spark, "test-waits")
    assert sorted((r.series, r.bin_seq, r.state5_code) for r in got.collect()) == [("a", 0, 2), ("a", 1, 2)]
    assert got.filter("bin_seq = 0").first().base == pytest.approx(2 / 3)


def test_finished_stream_of_flat_scores_is_the_batch_signal(spark, tmp_path):
    """A series that rarely moves has robust scores of 0 throughout; its scores are by mean and deviation then."""
    schema = "series string, bin_seq bigint, k int, state5_code int"
    rows = [("a", b, k, 2 if b in (30, 31, 70) else 0) for b in range(90) for k in range(-1, 2)]
    want = signals.derivative(spark.createDataFrame(rows, schema), 1, z_window=20, z_min=5).orderBy("bin_seq").collect()
    written = stream.to_table(runtime.derivatives(source(spark, tmp_path, [rows[:100], rows[100:]], schema), 1, z_window=20, z_min=5), spark, "test-flat")
    assert written.filter("signal <> 0").isEmpty()
    got = runtime.finished(written).orderBy("bin_seq").collect()
    assert np.abs([a.signal - b.signal for a, b in zip(got, want, strict=True)]).max() < 1e-12 < max(abs(r.signal) for r in want)
