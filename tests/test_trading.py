"""Detection, first hits, labels and summaries against loops over the series."""

import numpy as np
import pandas as pd
import pytest

from tidebook.operators import evaluate as E
from tidebook.operators import results


def brute_shots(x, t, cooldown, warmup=0):
    out, before, last = [], 0, -cooldown
    for i, v in enumerate(x[warmup:]):
        now = 1 if v >= t else -1 if v <= -t else 0
        if now and now != before and i - last >= cooldown:
            out.append((i + warmup, "up" if now > 0 else "down"))
            last = i
        before = now
    return out


def brute_outcome(mid, i, direction, tp, sl, hold, tick):
    entry, end = mid[i], min(i + hold, len(mid))
    for j in range(i + 1, end):
        gain = (mid[j] - entry) * (1 if direction == "up" else -1)
        if mid[j] <= 0:
            continue
        if gain >= tp * tick:
            return "tp", j
        if gain <= -sl * tick:
            return "sl", j
    return "timeout", end - 1


def frame(spark, x, name="signal"):
    return spark.createDataFrame(pd.DataFrame({"bin_seq": np.arange(len(x)), name: x}))


@pytest.mark.parametrize("cooldown", [1, 2, 4])
def test_suppressed_crossings_still_count_as_state(spark, cooldown):
    x = [0, 0.2, 0.2, -0.2, 0, 0.2]
    got = E.with_cooldown(E.crossings(frame(spark, x), [0.1]), cooldown).orderBy("bin_seq").collect()
    assert [(r.bin_seq, r.direction) for r in got] == brute_shots(x, 0.1, cooldown)


@pytest.mark.parametrize("chunk, cooldown, warmup", [(8, 5, 0), (8, 8, 13), (32, 3, 7), (4096, 20, 0)])
def test_detection_over_chunks(spark, chunk, cooldown, warmup):
    x = np.random.default_rng(chunk).normal(size=400) * 0.2
    got = E.with_cooldown(E.crossings(frame(spark, x), [0.1, 0.25], warmup, chunk), cooldown, chunk).toPandas()
    for t in (0.1, 0.25):
        rows = got[got.threshold == t].sort_values("bin_seq")
        assert list(zip(rows.bin_seq, rows.direction, strict=True)) == brute_shots(x, t, cooldown, warmup)


def test_candidates_have_no_edge(spark):
    p = [None, 0.7, 0.7, 0.2, 0.5, 0.9]
    df = spark.createDataFrame(list(enumerate(p)), "bin_seq bigint, prediction double")
    got = E.with_cooldown(E.candidates(df, [0.6]), 2).orderBy("bin_seq").collect()
    assert [(r.bin_seq, r.direction) for r in got] == [(1, "up"), (3, "down"), (5, "up")]
    got = E.candidates(df, [0.6], "confidence").orderBy("bin_seq").collect()
    assert [r.bin_seq for r in got] == [1, 2, 5]
    with pytest.raises(ValueError):
        E.candidates(df, [0.6], "other")


@pytest.mark.parametrize("chunk", [5, 4096])
def test_outcomes_and_labels(spark, chunk):
    rng = np.random.default_rng(3)
    mid = np.round(20 + np.cumsum(rng.normal(size=200)) * 0.5, 2)
    mid[rng.integers(0, 200, 20)] = 0
    bins = spark.createDataFrame(pd.DataFrame({"bin_seq": np.arange(200), "ts_ns": np.arange(200) * 10**8, "mid_price": mid}))
    shots = [(0.1, int(i), "up" if i % 2 else "down") for i in range(0, 200, 3)]
    got = E.outcomes(spark.createDataFrame(shots, "threshold double, bin_seq bigint, direction string"), bins, tp=4, sl=2, hold=15, chunk=chunk).orderBy("bin_seq").collect()
    want = [(i, *brute_outcome(mid, i, d, 4, 2, 15, 0.25)) for _, i, d in shots if mid[i] > 0]
    assert [(r.bin_seq, r.outcome) for r in got] == [(i, o) for i, o, _ in want]
    for r, (i, _, j) in zip(got, want, strict=True):
        assert r.outcome_price == mid[j]
        assert r.time_to_outcome_ms == pytest.approx((j - i) * 100)
    labels = {r.bin_seq: r.label for r in E.labels(bins, 4, 2, 15, chunk=chunk).collect()}
    for i in range(200):
        w = 0
        for j in range(i + 1, min(i + 15, 200)):
            if mid[i] > 0 and mid[j] > 0 and abs(mid[j] - mid[i]) >= 0.5:
                w = int(np.sign(mid[j] - mid[i]))
                break
        assert labels[i] == w


def test_summary_without_shots(spark):
    bins = spark.createDataFrame(pd.DataFrame({"bin_seq": [0, 1], "ts_ns": [0, 10**9], "mid_price": [1.0, 1.0]}))
    r = E.sweep(frame(spark, [0.0, 0.0]), bins, [0.5], 3, 0).first()
    assert (r.n_signals, r.n_up, r.tp_rate, r.events_per_hour) == (0, 0, None, 0.0)


def test_results(spark, tmp_path):
    rows = [("a", 0.1, 9, 0.4, 0.6), ("a", 0.2, 9, 0.4, 0.5), ("a", 0.3, 2, 0.9, 0.1), ("b", 0.1, 9, None, 0.2), ("b", 0.2, 8, float("nan"), 0.3)]
    runs = spark.createDataFrame(rows, "run_id string, threshold double, n_signals bigint, tp_rate double, sl_rate double")
    path = f"file://{tmp_path}/runs"
    results.append(runs.filter("run_id = 'a'"), path)
    results.append(runs.filter("run_id = 'b'").selectExpr("*", "1 as extra"), path)
    stored = results.load(spark, path)
    assert stored.count() == 5 and "extra" in stored.columns
    assert [(r.run_id, r.threshold) for r in results.best_per_run(runs.filter("run_id = 'a'")).collect()] == [("a", 0.1)]
    assert {r.run_id: r.threshold for r in results.tracked_best(runs).collect()} == {"a": 0.3, "b": 0.1}
    assert [r.threshold for r in results.ranked(runs, "sl_rate", 2).orderBy("rank").collect()] == [0.3, 0.1]
    assert results.filtered(runs, run_id="b", nothing=1).count() == 2
