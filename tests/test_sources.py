"""Scans, datasets on storage, joins in time, serving tables, the wire format and the entry points."""

import json

import pytest
from pyspark.sql import functions as F

from tidebook.operators import joins, quality, serving
from tidebook.schemas import FLAG_SNAPSHOT, NO_PRICE
from tidebook.sources import files, market, mbo, wire
from tidebook.streaming import bins as stream


def test_scan(spark):
    day = 1_770_336_000 * 10**9  # 2026-02-06 UTC
    rows = [
        (0, 160, 1, day - 5, "R", "N", NO_PRICE, 0, 0, FLAG_SNAPSHOT), (1, 160, 1, day - 99, "A", "B", 100, 5, 1, FLAG_SNAPSHOT), (2, 18, 1, day + 1, "A", "B", 100, 5, 2, 0), (3, 160, 2, day + 1, "A", "B", 100, 5, 3, 0),
        (4, 160, 1, day + 2, "A", "B", NO_PRICE, 5, 4, 0), (5, 160, 1, day + 3, "C", "B", NO_PRICE, 5, 5, 0), (6, 160, 1, day - 1, "A", "B", 100, 5, 6, 0), (7, 160, 9, day + 9, "A", "A", 101, 5, 7, 0),
    ]
    rec = spark.createDataFrame(rows, "seq bigint, rtype int, instrument_id int, ts_ns bigint, action string, side string, price_int bigint, size bigint, order_id bigint, flags int")
    names = spark.createDataFrame([(1, "MNQH6"), (2, "MNQH6-MNQM6")], "instrument_id int, raw_symbol string")
    got = mbo.scan(rec, names, "MNQ", "future_mbo", "2026-02-06").orderBy("seq").collect()
    assert [(r.seq, r.ts_ns - day, r.price_int) for r in got] == [(0, -5, 0), (1, -5, 100), (5, 3, 0), (7, 9, 101)]
    assert [r.seq for r in mbo.scan(rec, names, "MNQ", "future_mbo", "2026-02-06", day + 5).orderBy("seq").collect()] == [0, 1, 7]
    options = spark.createDataFrame([("C1", "C", "Q", "2026-02-06"), ("P1", "P", "Q", "2026-02-09"), ("F1", "F", "Q", "2026-02-06"), ("C2", "C", "X", "2026-02-06")], "raw_symbol string, instrument_class string, underlying string, expiry string").withColumn("expiry", F.col("expiry").cast("date"))
    assert [r[0] for r in mbo.option_symbols(options, "Q", "2026-02-06", True).collect()] == ["C1"]
    assert [r[0] for r in mbo.option_symbols(options, "Q", "2026-02-07").collect()] == ["P1"]


def test_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.range(5).selectExpr("id as bin_seq", "id * 2 as v", "id as flow_score", "id as proj_score_h1")
    assert files.publish(df, f"{root}/gen/d1").columns == ["bin_seq", "v"]
    df.write.parquet(f"{root}/cur/d2")
    assert files.dataset_ids(spark, f"{root}/cur", f"{root}/gen") == ["d1", "d2"]
    assert files.dataset_path(spark, f"{root}/cur", f"{root}/gen", "d1").endswith("gen/d1")
    assert files.scan(spark, f"{root}/cur/d2", ["v"]).columns == ["v"]
    with pytest.raises(KeyError):
        files.scan(spark, f"{root}/cur/d2", ["nope"])
    with pytest.raises(FileNotFoundError):
        files.dataset_path(spark, f"{root}/cur", f"{root}/gen", "d3")
    built = []
    build = lambda: built.append(1) or df
    for config in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert files.materialised(spark, f"{root}/m", config, build).count() == 5
    assert len(built) == 2
    spark.range(1).write.parquet(f"{root}/sym/symbol=MNQ")
    spark.range(1).write.parquet(f"{root}/sym/symbol=M")
    assert files.symbol_path(spark, f"{root}/sym", "MNQH6").endswith("symbol=MNQ")
    sums = files.checksums(spark, f"{root}/gen/d1").collect()
    assert sums and all(len(r.sha256) == 64 for r in sums)


def brute_as_of(left, right, strict, within):
    out = []
    for i, k, t in left:
        found = [(rt, v) for rk, rt, v in right if rk == k and (rt < t if strict else rt <= t)]
        best = max(found, default=None)
        out.append((i, best[1] if best and (within is None or t - best[0] <= within) else None))
    return out


@pytest.mark.parametrize("block", [3, 50, 10_000])
@pytest.mark.parametrize("strict, within", [(False, None), (True, 20)])
def test_as_of(spark, block, strict, within):
    left = [(i, "ab"[i % 2], (i * 37) % 211) for i in range(60)]
    right = [("ab"[i % 2], (i * 53) % 199, i) for i in range(1, 25)]
    a = spark.createDataFrame(left, "i bigint, key string, t bigint")
    b = spark.createDataFrame(right, "key string, rt bigint, v bigint")
    got = joins.as_of(a, b, ["key"], "t", "rt", ["v"], block, within, strict).orderBy("i").collect()
    assert [(r.i, r.v_at) for r in got] == brute_as_of(left, right, strict, within)


@pytest.mark.parametrize("block", [3, 50, 10_000])
def test_ahead(spark, block):
    rows = [(i, (i * 37) % 211) for i in range(60)]
    df = spark.createDataFrame(rows, "i bigint, t bigint").withColumn("key", F.lit(1))
    got = {r.i: r.i_ahead for r in joins.ahead(df, ["key"], "t", 30, ["i"], block).collect()}
    for i, t in rows:
        later = [(u, j) for j, u in rows if u >= t + 30]
        assert got[i] == (min(later)[1] if later else None)


def test_diff_and_dense(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, v string"), spark.createDataFrame([(2, None), (3, "z"), (4, "w")], "id int, v string")
    assert {r.id: r.status for r in joins.diff(a, b, "id", ["v"]).collect()} == {1: "removed", 2: "unchanged", 3: "changed", 4: "added"}
    cells = spark.createDataFrame([(0, -1, 2.0), (0, 5, 9.0), (1, 0, 3.0)], "b int, k int, x double")
    assert {r.b: r["values"] for r in joins.dense(cells, "b", "k", 1, "x").collect()} == {0: [2.0, 0.0, 0.0], 1: [0.0, 3.0, 0.0]}


def test_serving(spark):
    log = spark.createDataFrame([("a", "v1", 1), ("a", "v2", 3), ("b", "v1", 2)], "alias string, serving_id string, event_id int")
    assert {r.alias: r.serving_id for r in serving.latest(log, "alias", "event_id").collect()} == {"a": "v2", "b": "v1"}
    assert [(r.serving_id, r.previous) for r in serving.history(log, "alias", "event_id", "a").collect()] == [("v2", "v1"), ("v1", None)]
    versions = spark.createDataFrame([("r1", "h1", "s1")], "run_id string, config_hash string, serving_id string")
    new = spark.createDataFrame([("r1", "h1", "s9"), ("r1", "h2", "s2"), ("r1", "h2", "s2")], "run_id string, config_hash string, serving_id string")
    assert sorted(r.serving_id for r in serving.promote(versions, new).collect()) == ["s1", "s2"]


def test_quality(spark):
    bins = spark.createDataFrame([(0, 0, 1, 1.0, 1, 2), (1, 10, 0, 2.0, None, None), (2, 5, 1, 1.0, 3, 2)], "bin_seq bigint, ts_ns bigint, bin_event_count bigint, mid_price double, best_bid bigint, best_ask bigint")
    assert {r.rule: r.n_bad for r in quality.header_checks(bins).collect()} == {"sequence": 0, "time": 1, "spread": 1, "count": 0, "price": 0, "empty_price": 1}


def test_wire(spark):
    fields = [("k", "int32", "grid_index"), ("last_event_id", "int64", "metadata"), ("v_add", "float64", "velocity")]
    df = spark.range(3).selectExpr("double(id) as v_add", "id as last_event_id", "int(id) as k")
    t = wire.decode(wire.encode(df, fields))
    assert t.schema.names == ["k", "last_event_id", "v_add"] and str(t.schema.field("k").type) == "int32" and t.num_rows == 3
    assert json.loads(wire.header({"ts_ns": 1 << 60, "n": 2}, {"ts_ns"})) == {"ts_ns": str(1 << 60), "n": 2}


def test_triggers_may_cut_the_stream_anywhere(spark, tmp_path):
    rows = [(i, i % 3, float((i * 37) % 100), 0) for i in range(90)]
    schema = "event_id bigint, user_id bigint, value double, cents bigint"
    for n in range(3):
        spark.createDataFrame(rows[n * 30 : n * 30 + 30], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
    read = lambda per: spark.readStream.schema(schema).option("maxFilesPerTrigger", per).parquet(f"file://{tmp_path}/in/*")
    whole, parts = (sorted(map(tuple, stream.to_table(stream.detected(read(n), 60.0, 3), spark, "t").collect())) for n in (9, 1))
    assert whole and whole == parts
    sent = stream.to_batches(read(1), spark, "w", lambda b, i: (i, b.count()))
    assert sorted(sent) == [(0, 30), (1, 30), (2, 30)]


def test_entry(spark, small_dir):
    import __spark_entry__ as e

    assert e.oracle_sql().keys() <= e.queries().keys()
    df = e.entry(spark)
    assert df.columns == ["bin_seq", "k", "composite", "flow_score", "state5_code", "flow_state_code"]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Bare

    from tidebook.sources.files import scratch

    context = Bare(master="spark://host:7077", getConf=lambda: {})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(Bare(conf={}, sparkContext=context))
    assert scratch(Bare(conf={"spark.checkpoint.dir": "hdfs:/x/"}, sparkContext=context)) == "hdfs:/x"


@pytest.mark.parametrize("block", [3, 1000])
def test_interpolated(spark, block):
    """Against a line through the neighbours by hand: exact hits, ends, nulls and keys without a partner."""
    import bisect
    import random

    rng = random.Random(4)
    known = {k: sorted({rng.randrange(60): rng.choice([None, rng.random(), rng.random()]) for _ in range(20)}.items()) for k in "ab"}
    asked = [(i, rng.choice("abc"), rng.randrange(-3, 63)) for i in range(200)]

    def line(k, t):
        rows = known.get(k, [])
        times = [x for x, _ in rows]
        lo, hi = bisect.bisect_right(times, t) - 1, bisect.bisect_left(times, t)
        if lo < 0 or hi == len(rows) or rows[lo][1] is None or rows[hi][1] is None:
            return None
        return rows[lo][1] if lo == hi else rows[lo][1] + (rows[hi][1] - rows[lo][1]) * (t - times[lo]) / (times[hi] - times[lo])

    right = spark.createDataFrame([(k, t, v) for k, rows in known.items() for t, v in rows], "key string, at bigint, v double")
    got = joins.interpolated(spark.createDataFrame(asked, "i int, key string, t bigint"), right, ["key"], "t", "at", ["v"], block).collect()
    assert {r.i: r.v_at for r in got} == pytest.approx({i: line(k, t) for i, k, t in asked}, abs=1e-12)


def test_order_events_in_bounded_tasks(spark, small_dir, monkeypatch):
    """Many lines make more tasks than the session's number of partitions, with the same events."""
    few = market.order_events(spark, small_dir)
    monkeypatch.setattr(market, "TASK_LINES", 500)
    many = market.order_events(spark, small_dir)
    lines = market.table(spark, small_dir, "lineitem").count()
    assert many.rdd.getNumPartitions() == -(-lines // 500) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert many.exceptAll(few).isEmpty() and few.exceptAll(many).isEmpty()
