"""Window functions and kernels against plain Python, over chunks small enough to need their halos."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.functions import kernels
from tidebook.functions import windows as W
from tidebook.functions.chunks import apply_chunks, over_chunks
from tidebook.functions.quantiles import percentiles
from tidebook.functions.totals import running_totals


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(42)
    return pd.DataFrame({"k": np.repeat([0, 1], 60), "b": np.tile(np.arange(60), 2), "x": rng.normal(size=120)})


def brute_z(x, window, least, eps=1e-12):
    out = np.zeros(len(x))
    for i in range(len(x)):
        seg = x[max(0, i - window + 1) : i + 1]
        if len(seg) < least or np.isnan(seg).any():
            continue
        m = np.median(seg)
        s = 1.4826 * np.median(np.abs(seg - m))
        if s > eps:
            out[i] = (x[i] - m) / s
    return out


def brute_slope(x, n):
    out = np.full(len(x), np.nan)
    for i in range(n - 1, len(x)):
        out[i] = np.polyfit(np.arange(n), x[i - n + 1 : i + 1], 1)[0]
    return out


@pytest.mark.parametrize("chunk", [7, 16, 4096])
def test_windows_do_not_depend_on_chunks(spark, series, chunk):
    df = spark.createDataFrame(series)

    def build(p, axis):
        return p.withColumns({"mean": W.trailing_mean(axis, "x", 5), "slope": W.slope(axis, "x", 6), "skew": W.full_skew(axis, "x", 5), "std": W.full_std(axis, "x", 4), "lag": W.lagged(axis, "x", 3), "padded": W.padded_mean(axis, "x", 4)})

    got = over_chunks(df, ["k"], "b", 6, build, chunk=chunk).orderBy("k", "b").toPandas()
    assert len(got) == len(series)
    for k in (0, 1):
        x = series.x[series.k == k].to_numpy()
        g = got[got.k == k].reset_index(drop=True)
        s = pd.Series(x)
        np.testing.assert_allclose(g["mean"], s.rolling(5, min_periods=1).mean(), atol=1e-12)
        np.testing.assert_allclose(g["slope"].astype(float), brute_slope(x, 6), atol=1e-9)
        np.testing.assert_allclose(g["std"], s.rolling(4).std(ddof=0).fillna(0), atol=1e-9)
        np.testing.assert_allclose(g["lag"], s.shift(3).fillna(0))
        np.testing.assert_allclose(g["padded"], np.convolve(x, np.ones(4) / 4)[: len(x)], atol=1e-12)
        m = s.rolling(5).mean()
        skew = [0 if i < 4 else ((x[i - 4 : i + 1] - m[i]) ** 3).mean() / x[i - 4 : i + 1].var() ** 1.5 for i in range(len(x))]
        np.testing.assert_allclose(g["skew"], skew, atol=1e-8)


@pytest.mark.parametrize("chunk", [9, 4096])
def test_recursions_do_not_depend_on_chunks(spark, series, chunk):
    alpha = 0.9

    def kernel(p):
        return pd.DataFrame({"e": kernels.ema(p["x"].to_numpy(), alpha), "z": kernels.robust_z(p["x"].to_numpy(), 12, 4)})

    halo = max(12, kernels.ema_halo(alpha))
    got = apply_chunks(spark.createDataFrame(series), ["k"], "b", halo, kernel, "e double, z double", chunk=chunk).orderBy("k", "b").toPandas()
    for k in (0, 1):
        x = series.x[series.k == k].to_numpy()
        e = [x[0]]
        for v in x[1:]:
            e.append(alpha * v + (1 - alpha) * e[-1])
        np.testing.assert_allclose(got.e[got.k == k], e, atol=1e-12)
        np.testing.assert_allclose(got.z[got.k == k], brute_z(x, 12, 4), atol=1e-12)


def test_robust_z_edges():
    x = np.array([1.0, 2.0, np.nan, 3.0, 4.0, 5.0, 6.0])
    np.testing.assert_allclose(kernels.robust_z(x, 3, 2), brute_z(x, 3, 2))
    assert not kernels.robust_z(np.full(9, 2.0), 4, 2).any()
    assert not kernels.robust_z(np.arange(5.0), 8, 6).any()
    assert len(kernels.robust_z(np.zeros(0), 4, 2)) == 0


def test_golden_score_vector():
    """200 bins of five cells drawn with seed 42; the scores of bin 100 are known values."""
    rng = np.random.default_rng(42)
    d = [rng.normal(size=(200, 5)) * s for s in (0.1, 0.01, 0.001)]
    want = [0.2475041700366693, 0.11508414445839743, 0.05433544837187774, -0.19326904783776142, -0.37801281218732985]
    for cell in range(5):
        zs = [kernels.robust_z(x[:, cell], 300, 75, 1e-9) for x in d]
        score = kernels.tanh_blend(zs, [0.55, 0.30, 0.15], 3.0)
        assert not score[:74].any()
        assert score[100] == pytest.approx(want[cell], abs=1e-12)


def test_decayed_max():
    x, m, want = np.random.default_rng(1).normal(size=50), 0.0, []
    for v in x:
        m = max(0.9 * m, abs(v))
        want.append(m)
    np.testing.assert_allclose(kernels.decayed_max(x, 0.9), want)


@pytest.mark.parametrize("strict, want", [(True, [[0, 10, 20, 30, 40], [0, 0, 100, 100, 100], [0, 0, 0, 0, 0]]), (False, [[0, 10, 20, 30, 40], [0, 100, 100, 100, 100], [0, 1000, 0, 0, 0]])])
def test_derivatives_at_the_head(spark, strict, want):
    x = np.cumsum([0, 1, 2, 3, 4.0])
    df = spark.createDataFrame(pd.DataFrame({"b": range(5), "x": x}))

    def build(p, axis):
        return p.withColumns({f"d{i}": c for i, c in enumerate(W.derivatives(axis, "x", 0.1, strict))})

    got = over_chunks(df, [], "b", 3, build, chunk=2).orderBy("b").toPandas()
    np.testing.assert_allclose(got[["d0", "d1", "d2"]].T, want, atol=1e-9)


@pytest.mark.parametrize("chunk", [3, 1000])
def test_running_totals(spark, chunk):
    pdf = pd.DataFrame({"k": ["a", "b", None] * 20, "s": range(60), "v": np.arange(60) % 7 - 3})
    got = running_totals(spark.createDataFrame(pdf), ["k"], "s", {"t": "v"}, chunk).orderBy("s").toPandas()
    want = pdf.groupby("k", dropna=False).v.cumsum()
    assert got.t.tolist() == want.tolist()
    assert running_totals(spark.createDataFrame(pdf).filter(F.lit(False)), ["k"], "s", {"t": "v"}).count() == 0


@pytest.mark.parametrize("cuts, few", [(4096, 2048), (3, 1), (2, 5)])
def test_percentiles_by_selection(spark, cuts, few):
    """Ties, tiny and huge numbers, groups, nulls and NaN, whatever the size of the parts."""
    rng = np.random.default_rng(5)
    groups = {"ties": rng.integers(0, 4, 500) / 3, "spread": rng.normal(size=400) * 10.0 ** rng.integers(-9, 9, 400), "ends": np.array([-1.7e308, 1.7e308, 0.0, -0.0, 5e-324, 1.0]), "one": np.array([7.0]), "same": np.full(300, -2.5)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("ties", None), ("one", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    shares = [0.0, 0.05, 0.5, 0.731, 0.95, 1.0]
    got = percentiles(df, F.col("x"), shares, F.col("g"), cuts, few)
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        xs = np.sort(xs)
        for q, value in zip(shares, got[g], strict=True):
            low, high = int(np.floor((len(xs) - 1) * q)), int(np.ceil((len(xs) - 1) * q))
            w = (len(xs) - 1) * q - low
            assert value == pytest.approx(xs[low] if low == high else (1 - w) * xs[low] + w * xs[high], rel=1e-12, abs=1e-300), (g, q)
    assert percentiles(df.filter("g = 'none'"), F.col("x"), [0.5]) == {}
    whole = df.filter("x is not null and not isnan(x)")
    assert percentiles(df, F.col("x"), [0.25, 0.9], None, cuts, few)[None] == pytest.approx(whole.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.9)))).first()[0])
