import json

import numpy as np
import pytest

from tidebook.operators import quality
from tidebook.streaming import telemetry as T


def records(spark, n):
    values = np.random.default_rng(1).random(n)
    rows = [(i, i * 100, (i + 1) * 100, float(v)) for i, v in enumerate(values)]
    return values, spark.createDataFrame(rows, "number bigint, bin_start_ns bigint, bin_end_ns bigint, lag double")


def test_summaries_of_the_last_records(spark):
    values, df = records(spark, 130)
    got = {r.number: r for r in T.summaries(df, "lag", every=20, sample=50).collect()}
    assert sorted(got) == [19, 39, 59, 79, 99, 119]
    for i, r in got.items():
        last = values[max(0, i - 49) : i + 1]
        assert r.n == len(last) and [r.p50, r.p95, r.p99] == pytest.approx(np.percentile(last, [50, 95, 99]).tolist())


def test_window_and_json_lines(spark, tmp_path):
    _, df = records(spark, 20)
    inside = T.in_window(df, 300, 600)
    assert sorted(r.number for r in inside.collect()) == [3, 4, 5]
    for _ in range(2):
        T.to_jsonl(inside.coalesce(1), f"file://{tmp_path}/log")
    lines = [json.loads(x) for p in (tmp_path / "log").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(x["number"] for x in lines) == [3, 3, 4, 4, 5, 5]


def test_stream_of_records(spark, tmp_path):
    _, df = records(spark, 7)
    df.write.json(f"file://{tmp_path}/in")
    query = T.to_jsonl(spark.readStream.schema(df.schema).json(f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    query.processAllAvailable()
    query.stop()
    assert spark.read.json(f"file://{tmp_path}/out").count() == 7


def test_grid_checks(spark):
    grid = spark.createDataFrame([(b, k, 0.0 if b else None) for b in range(3) for k in range(4)], "bin_seq bigint, k int, x double")
    assert quality.dense(grid, 4).count() == 12 and quality.active(grid, ["x"]).count() == 0
    with pytest.raises(Exception, match="bin 1 has 3 cells instead of 4"):
        quality.dense(grid.filter("bin_seq != 1 or k != 2"), 4).collect()
    with pytest.raises(ValueError):
        quality.between(grid, 5, 9, "bin_seq")
