"""A declared feature graph: named nodes over silver columns that become DataFrame columns.

Nodes are dictionaries with a ``type``: silver_ref, temporal_window, spatial_neighborhood, arithmetic, norm and
output. Checks come first; then every node that some output needs becomes one Column expression. What runs is
Catalyst's business: nodes along time share one shuffle by level and chunk, nodes along the price axis one by
bin, and nodes that no output needs don't exist.
"""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import kernels
from tidebook.functions import windows as W
from tidebook.functions.chunks import CHUNK, apply_chunks, over_chunks
from tidebook.functions.quantiles import percentiles
from tidebook.functions.scalar import div_eps, json_hash
from tidebook.schemas import SILVER
from tidebook.sources.files import stored

#: Fields that each node type takes: those that name other nodes, then the rest.
FIELDS = {
    "silver_ref": ((), ("field",)),
    "temporal_window": (("source",), ("window_bins", "agg", "alpha")),
    "spatial_neighborhood": (("source",), ("radius", "agg")),
    "arithmetic": (("left", "right"), ("op",)),
    "norm": (("source",), ("method", "window_bins")),
    "output": (("source",), ("name", "dtype")),
}
TIME_AGGS, SPACE_AGGS = ("mean", "std", "min", "max", "sum", "ewm"), ("mean", "std", "sum", "max")
OPS, NORMS = ("add", "sub", "mul", "div", "abs_diff"), ("zscore", "minmax", "log1p", "tanh")


def refs(node: dict) -> list[str]:
    return [node[f] for f in FIELDS[node["type"]][0] if f in node]


def check(spec: dict) -> list[str]:
    """What is wrong with a spec ``{"version": 1, "nodes": {name: node}}``; nothing if the list is empty."""
    errors, nodes = [], spec.get("nodes", {})
    if spec.get("version") != 1:
        errors.append("version must be 1")
    for name, node in nodes.items():
        if node.get("type") not in FIELDS:
            errors.append(f"{name}: unknown type {node.get('type')}")
            continue
        inputs, rest = FIELDS[node["type"]]
        errors += [f"{name}: unknown field {f}" for f in node if f not in (*inputs, *rest, "type")]
        errors += [f"{name}: lacks {f}" for f in inputs if f not in node]
        errors += [f"{name}: refers to {r}, which isn't there" for r in refs(node) if r not in nodes]
    if errors:
        return errors
    try:
        list(TopologicalSorter({n: refs(x) for n, x in nodes.items()}).static_order())
    except CycleError as e:
        return [f"nodes refer to each other in a circle: {e.args[1]}"]
    outputs = [x for x in nodes.values() if x["type"] == "output"]
    names = [x.get("name") for x in outputs]
    if not outputs:
        errors.append("there is no output")
    if len(set(names)) != len(names):
        errors.append("output names repeat")
    for name, x in nodes.items():
        kind = x["type"]
        if kind == "silver_ref" and x.get("field") not in SILVER | {"k"}:
            errors.append(f"{name}: {x.get('field')} isn't a silver column")
        if kind == "temporal_window":
            if x.get("agg") not in TIME_AGGS or x.get("window_bins", 0) < 1:
                errors.append(f"{name}: bad window")
            elif x["agg"] == "ewm" and not 0 < (x.get("alpha") or 0) < 1:
                errors.append(f"{name}: ewm takes an alpha between 0 and 1")
        if kind == "spatial_neighborhood" and (x.get("agg") not in SPACE_AGGS or x.get("radius", 0) < 1):
            errors.append(f"{name}: bad neighborhood")
        if kind == "arithmetic" and x.get("op") not in OPS:
            errors.append(f"{name}: unknown operation")
        if kind == "norm" and (x.get("method") not in NORMS or x["method"] == "zscore" and x.get("window_bins", 0) < 2):
            errors.append(f"{name}: bad norm")
        if kind == "output" and (not str(x.get("name", "")).isidentifier() or x["name"] != x["name"].lower() or x.get("dtype", "float64") not in ("float32", "float64")):
            errors.append(f"{name}: bad output")
        if kind in ("arithmetic", "norm") and any(nodes[r]["type"] == "output" for r in refs(x)):
            errors.append(f"{name}: reads an output")
    return errors


def identity(spec: dict) -> str:
    return json_hash(spec)


def needed(spec: dict) -> list[str]:
    """Names of the nodes that some output depends on, in an order that puts inputs first."""
    nodes = spec["nodes"]
    todo, seen = [n for n, x in nodes.items() if x["type"] == "output"], set()
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += refs(nodes[n])
    return [n for n in TopologicalSorter({n: refs(nodes[n]) for n in sorted(seen)}).static_order()]


def evaluate(lattice: DataFrame, spec: dict, first_bins: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """``bin_seq, k`` and the outputs. `first_bins` bins are cut off before any window, so windows see no more."""
    if errors := check(spec):
        raise ValueError("; ".join(errors))
    df = lattice if first_bins is None else lattice.filter(F.col("bin_seq") < first_bins)
    nodes, order = spec["nodes"], needed(spec)
    fields = sorted({nodes[n]["field"] for n in order if nodes[n]["type"] == "silver_ref"} - {"k"})
    df = df.select("bin_seq", "k", *fields)
    c = lambda n: F.col(f"n_{n}")
    for name in order:
        x = nodes[name]
        kind, to = x["type"], f"n_{name}"
        if kind == "silver_ref":
            df = df.withColumn(to, F.col(x["field"]).cast("double"))
        elif kind == "output":
            df = df.withColumn(to, c(x["source"]))
        elif kind == "temporal_window" and x["agg"] == "ewm":
            alpha, source = x["alpha"], f"n_{x['source']}"
            df = apply_chunks(df, ["k"], "bin_seq", kernels.ema_halo(alpha), lambda p, a=alpha, s=source, t=to: pd.DataFrame({t: kernels.ema(p[s].to_numpy(), a)}), f"{to} double", chunk=chunk)
        elif kind == "temporal_window":
            df = over_chunks(df, ["k"], "bin_seq", x["window_bins"], lambda p, axis, x=x, t=to: p.withColumn(t, W.trailing(axis, f"n_{x['source']}", x["window_bins"], x["agg"])), chunk=chunk)
        elif kind == "spatial_neighborhood":
            w = Window.partitionBy("bin_seq").orderBy("k").rowsBetween(-x["radius"], x["radius"])
            f = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "max": F.max}[x["agg"]]
            df = df.withColumn(to, f(c(x["source"])).over(w))
        elif kind == "arithmetic":
            a, b = c(x["left"]), c(x["right"])
            df = df.withColumn(to, {"add": a + b, "sub": a - b, "mul": a * b, "div": div_eps(a, b), "abs_diff": F.abs(a - b)}[x["op"]])
        elif x["method"] == "zscore":
            df = over_chunks(df, ["k"], "bin_seq", x["window_bins"], lambda p, axis, x=x, t=to: p.withColumn(t, W.z_score(axis, f"n_{x['source']}", x["window_bins"])), chunk=chunk)
        elif x["method"] == "minmax":
            ends = df.agg(F.min(c(x["source"])).alias("lo"), F.max(c(x["source"])).alias("hi")).first()  # two numbers
            width = (ends["hi"] or 0) - (ends["lo"] or 0)
            df = df.withColumn(to, (c(x["source"]) - ends["lo"]) / width if width >= 1e-12 else F.lit(0.0))
        else:
            df = df.withColumn(to, F.log1p(F.abs(c(x["source"]))) if x["method"] == "log1p" else F.tanh(c(x["source"])))
    kinds = {"float32": "float", "float64": "double"}
    outputs = [c(n).cast(kinds[nodes[n].get("dtype", "float64")]).alias(nodes[n]["name"]) for n in order if nodes[n]["type"] == "output"]
    return df.select("bin_seq", "k", *outputs)


def stats(df: DataFrame) -> DataFrame:
    """``output, mean, std, q25, q50, q75, n_valid, n_nan`` of every output: one aggregation, and percentiles by selection."""
    names = [c for c in df.columns if c not in ("bin_seq", "k")]
    long = stored(df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("output"), F.col(n).cast("double").alias("x")) for n in names])).alias("r")).select("r.*"), "outputs")
    bad = F.col("x").isNull() | F.isnan("x")
    x = F.when(~bad, F.col("x"))
    found = percentiles(long, F.col("x"), (0.25, 0.5, 0.75), F.col("output"))
    quarters = df.sparkSession.createDataFrame([(n, *found.get(n, [None] * 3)) for n in names], "output string, q25 double, q50 double, q75 double")
    out = long.groupBy("output").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count(x).alias("n_valid"), F.count_if(bad).alias("n_nan"))
    return out.join(F.broadcast(quarters), "output").select("output", "mean", "std", "q25", "q50", "q75", "n_valid", "n_nan")


def lineage(old: dict, new: dict) -> dict[str, list[str]]:
    """Nodes added, removed, changed and kept between two specs."""
    a, b = old["nodes"], new["nodes"]
    both = sorted(a.keys() & b.keys())
    return {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "changed": [n for n in both if a[n] != b[n]], "unchanged": [n for n in both if a[n] == b[n]]}


def from_legacy(c: dict[str, float], alpha: float = 0.2) -> dict:
    """A graph in the shape of the fixed force formula: pressure and vacuum inputs, their difference, smoothed.

    It names the same columns; coefficients other than 1 have no node, so it isn't the same numbers.
    """
    ref = lambda f: {"type": "silver_ref", "field": f}
    nodes = {n: ref(n) for n in ("v_add", "v_pull", "v_fill")}
    nodes |= {"vacuum": {"type": "arithmetic", "op": "add", "left": "v_pull", "right": "v_fill"}, "net": {"type": "arithmetic", "op": "sub", "left": "v_add", "right": "vacuum"}}
    nodes |= {"smooth": {"type": "temporal_window", "source": "net", "window_bins": 5, "agg": "ewm", "alpha": alpha}, "out": {"type": "output", "source": "smooth", "name": "flow_score"}}
    return {"version": 1, "nodes": nodes}
