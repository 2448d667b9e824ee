"""The feature graph: checks, values, identity; sweeps, schemas and scalar functions."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook import schemas
from tidebook.functions import scalar
from tidebook.operators.gold import state5
from tidebook.plans import features, sweep

REF = {"type": "silver_ref", "field": "v_add"}
OUT = {"type": "output", "source": "a", "name": "x"}


def spec(**nodes):
    return {"version": 1, "nodes": nodes}


@pytest.mark.parametrize("bad, word", [
    ({"version": 2, "nodes": {}}, "version"), (spec(a=REF), "no output"), (spec(a={"type": "silver_ref", "field": "nope"}, o=OUT), "silver column"), (spec(o=OUT), "isn't there"),
    (spec(a={"type": "norm", "source": "b", "method": "tanh"}, b={"type": "norm", "source": "a", "method": "tanh"}, o=OUT), "circle"), (spec(a=REF, o=OUT, p=OUT), "repeat"),
    (spec(a=REF, w={"type": "temporal_window", "source": "a", "window_bins": 5, "agg": "ewm"}, o=OUT), "alpha"), (spec(a=REF, z={"type": "norm", "source": "a", "method": "zscore"}, o=OUT), "norm"),
    (spec(a=REF, o=OUT, b={"type": "norm", "source": "o", "method": "tanh"}), "reads an output"), (spec(a=REF | {"extra": 1}, o=OUT), "unknown field"), (spec(a={"type": "code"}, o=OUT), "unknown type"),
    (spec(a=REF, o=OUT | {"name": "Not Snake"}), "bad output"),
])
def test_checks(bad, word):
    assert any(word in e for e in features.check(bad))


def test_only_needed_nodes(spark):
    s = spec(a=REF, unused={"type": "silver_ref", "field": "j_add"}, o=OUT | {"dtype": "float32"})
    lattice = spark.createDataFrame([(0, 0, 1.5)], "bin_seq bigint, k int, v_add double")
    df = features.evaluate(lattice, s)  # j_add isn't there, and isn't asked for
    assert df.schema["x"].dataType == T.FloatType() and df.first()["x"] == 1.5
    with pytest.raises(ValueError):
        features.evaluate(lattice, spec(a=REF))


@pytest.mark.parametrize("chunk", [6, 4096])
def test_values(spark, chunk):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame([(b, k, rng.normal()) for b in range(30) for k in range(-2, 3)], columns=["bin_seq", "k", "v_add"])
    s = spec(a=REF, w={"type": "temporal_window", "source": "a", "window_bins": 4, "agg": "std"}, n={"type": "spatial_neighborhood", "source": "w", "radius": 1, "agg": "max"}, o={"type": "output", "source": "n", "name": "x"})
    got = features.evaluate(spark.createDataFrame(pdf), s, chunk=chunk).toPandas().set_index(["bin_seq", "k"]).x
    wide = pdf.pivot(index="bin_seq", columns="k", values="v_add").rolling(4, min_periods=1).std()
    for (b, k), v in got.items():
        near = wide.loc[b, max(-2, k - 1) : min(2, k + 1)]
        assert np.isnan(v) or v is None if near.isna().all() else v == pytest.approx(near.max())


def test_identity_and_lineage():
    a, b = spec(a=REF, o=OUT), {"nodes": {"o": dict(reversed(OUT.items())), "a": REF}, "version": 1}
    assert features.identity(a) == features.identity(b) and len(features.identity(a)) == 64
    c = spec(a=REF | {"field": "v_pull"}, o=OUT, n=REF)
    assert features.lineage(a, c) == {"added": ["n"], "removed": [], "changed": ["a"], "unchanged": ["o"]}
    assert not features.check(features.from_legacy({}))


def test_sweep():
    runs = sweep.runs({"a": [1, 2], "b": ["x", "y", "z"]})
    assert len(runs) == 6 and len({r["run_id"] for r in runs}) == 6 and runs == sweep.runs({"a": [1, 2], "b": ["x", "y", "z"]})
    assert len(sweep.runs({"a": range(10)}, most=3)) == 3
    assert sweep.required_columns(["ads", "pfp"]) == ["v_add", "v_fill", "v_pull"]


def test_schemas(spark):
    good = [("k", "int32", "grid_index"), ("last_event_id", "int64", "metadata"), ("v_add", "float64", "velocity")]
    schemas.check_wire(good)
    for bad in (good[1:], [*good, good[0]], [*good, ("x", "int32", "velocity")], [*good, ("x", "float64", "indicator")], [*good, ("x", "int8", "other")]):
        with pytest.raises(ValueError):
            schemas.check_wire(bad)
    t = schemas.from_arrow(pa.schema([("a", pa.float64()), ("b", pa.int8()), ("c", pa.int64()), ("d", pa.string()), ("e", pa.timestamp("us")), ("f", pa.bool_())]))
    assert [f.dataType.simpleString() for f in t] == ["double", "int", "bigint", "string", "double", "boolean"]
    df = spark.range(1).selectExpr("id as bin_seq", "1 as k", "1.0 as v_add", "2.0 as flow_score")
    assert schemas.allowed(df, schemas.SILVER).columns == ["bin_seq", "k", "v_add"]
    with pytest.raises(KeyError):
        schemas.require(df, ["nope"], "it")


def test_scalars(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-3.0,), (0.25,), (None,)], "x double")
    assert [r[0] for r in df.select(scalar.unit_interval(F.col("x"))).collect()] == [0.0, 1.0, -1.0, 0.25, 0.0]
    assert [r[0] for r in df.select(scalar.json_safe(F.col("x"))).collect()] == [None, None, -3.0, 0.25, None]
    one = spark.range(1).select(
        scalar.tick(F.lit(2.5), 1.0, 2, 8).alias("up"), scalar.tick(F.lit(99.0), 1.0, 2, 8).alias("out"), scalar.slug(F.lit(" A-b  C! ")).alias("slug"), scalar.decay_alpha(F.lit(-1.0), 2.0).alias("a0"), scalar.decay_alpha(F.lit(500.0), 2.0).alias("a1"),
        scalar.wall_clock_ns(F.lit("2026-02-06").cast("date"), F.lit("09:30:00"), warmup_minutes=30).alias("winter"), scalar.wall_clock_ns(F.lit("2026-07-06").cast("date"), F.lit("09:30:00")).alias("summer"), scalar.iso(F.lit(1_500_000_000).cast("long")).alias("iso"),
        scalar.projection(F.lit(0.1), F.lit(0.2), F.lit(0.4), F.lit(0.0), 0.5).alias("ahead"),
    ).first()
    assert (one.up, one.out, one.slug, one.a0, one.a1) == (5, None, "a_b_c", 0.0, 1.0)
    assert one.winter == 1770386400 * 10**9 and one.summer == 1783344600 * 10**9
    assert one.iso == "1970-01-01T00:00:01.500000Z" and one.ahead == pytest.approx(0.1 + 0.1 + 0.05)
    assert scalar.config_hash({"b": 1, "a": 2}) == scalar.config_hash({"a": 2, "b": 1})


def test_state5(spark):
    rows = [(k, a, b) for k in (-1, 0, 1) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    got = {(r.k, r.a, r.b): r.s for r in spark.createDataFrame(rows, "k int, a int, b int").withColumn("s", state5(F.col("k"), F.col("a"), F.col("b"))).collect()}
    assert all(got[0, a, b] == 0 for a in (-1, 0, 1) for b in (-1, 0, 1))
    assert [got[1, 1, 1], got[1, 0, 1], got[1, -1, 1], got[1, 0, 0], got[1, 1, 0], got[1, -1, -1]] == [2, 2, 0, 0, -1, -1]
    assert [got[-1, 1, 1], got[-1, 0, 1], got[-1, -1, 1], got[-1, 0, 0], got[-1, 1, 0], got[-1, -1, -1]] == [1, 1, 0, 0, -2, -2]
