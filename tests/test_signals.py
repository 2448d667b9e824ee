"""Signals and models: zero input, errors, direction, and independence of chunks."""

import numpy as np
import pandas as pd
import pytest

from tidebook.operators import learned
from tidebook.operators import signals as X
from tidebook.operators.gold import GoldConfig, gold

R = 3
COLUMNS = ["v_add", "v_pull", "v_fill", "v_rest_depth", "a_add", "a_pull", "j_add", "j_pull", "pressure_variant", "vacuum_variant", "flow_score"]


def lattice(n=90, seed=7, zero=False):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"bin_seq": np.repeat(np.arange(n), 2 * R + 1), "k": np.tile(np.arange(-R, R + 1), n)})
    for c in COLUMNS:
        pdf[c] = 0.0 if zero else np.abs(rng.normal(size=len(pdf)))
    for c in ("state5_code", "flow_state_code"):
        pdf[c] = 0 if zero else rng.integers(-1, 2, len(pdf))
    return pdf


@pytest.mark.parametrize("name", sorted(X.REGISTRY))
def test_zero_input(spark, name):
    got = X.compute(name, spark.createDataFrame(lattice(40, zero=True)), R).toPandas()
    assert len(got) == 40 and np.allclose(got.signal, 0)


PARAMETERS = {
    "ads": {"windows": (3, 4, 5), "z_window": 10, "z_min": 4}, "erd": {"z_window": 10, "z_min": 4}, "jad": {"z_window": 10, "z_min": 4}, "iirc": {"windows": (3, 5)}, "derivative": {"z_window": 10, "z_min": 4},
    "pfp": {"alpha": 0.8, "outer": (2, 3), "lag": 2}, "spg": {"fast": 1.5, "slow": 2, "curve": 2}, "ads_pfp_svac": {"slope_ms": (300, 400, 500), "z_ms": 1000, "z_ratio": 0.4, "warmup_ms": 800, "lag_ms": 200, "alpha": 0.8, "svac_alpha": 0.8, "outer": (2, 3)},
}


@pytest.mark.parametrize("name", sorted(PARAMETERS))
def test_chunks_do_not_matter(spark, name):
    df = spark.createDataFrame(lattice())
    whole, cut = (X.compute(name, df, R, chunk=c, **PARAMETERS[name]).orderBy("bin_seq").toPandas().signal for c in (4096, 17))
    assert whole.abs().max() > 0
    np.testing.assert_allclose(whole, cut, atol=1e-9)


def test_errors(spark):
    df = spark.createDataFrame(lattice(5))
    with pytest.raises(KeyError):
        X.compute("ads", df.drop("v_add"), R)
    with pytest.raises(TypeError):
        X.compute("ads", df, R, unknown=1)
    with pytest.raises(ValueError):
        X.compute("erd", df, R, variant="c")
    with pytest.raises(ValueError):
        X.compute("derivative", df, R, d_weights=(0, 0, 0))


def test_direction(spark):
    pdf = lattice(20, zero=True)
    pdf.loc[pdf.k > 0, "vacuum_variant"] = 1.0
    assert (X.compute("msd", spark.createDataFrame(pdf), R).toPandas().signal > 0).all()
    rising = lattice(60, zero=True)
    rising.loc[rising.k < 0, "v_add"] = rising.bin_seq**1.5
    assert X.compute("iirc", spark.createDataFrame(rising), R).orderBy("bin_seq").toPandas().signal.iloc[-1] > 0


def test_gold_chunks(spark):
    pdf = lattice(60).assign(ask_reprice_sign=1, bid_reprice_sign=1)
    pdf = pdf.drop(columns=["pressure_variant", "vacuum_variant", "flow_score", "state5_code", "flow_state_code"])
    cfg = {"windows": (2, 4), "weights": (0.6, 0.4), "z_window": 8, "z_min": 2}
    a, b = (gold(spark.createDataFrame(pdf), GoldConfig(**cfg, chunk=c)).orderBy("k", "bin_seq").toPandas() for c in (4096, 13))
    assert set(a.columns) == {"bin_seq", "k", "pressure_variant", "vacuum_variant", "composite", "composite_d1", "composite_d2", "composite_d3", "state5_code", "flow_score", "flow_state_code"}
    np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), atol=1e-9)


@pytest.mark.parametrize("fit", [learned.knn(5), learned.linear_svm(1.0, True), learned.boosted_stumps()])
def test_models_learn(fit):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = np.sign(x[:, 0] + 0.3 * x[:, 1])
    p = fit(x[:400], y[:400])(x[400:])
    middle = 0.5 if 0 <= p.min() and p.max() <= 1 else 0
    assert (np.sign(p - middle) == y[400:]).mean() > 0.85


def test_walk_forward_sees_the_past_only(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    pdf = pd.DataFrame({"bin_seq": range(200), "x": x, "label": np.where(x > 0, 1, -1)})
    run = lambda d: learned.walk_forward(spark.createDataFrame(d), "label", learned.knn(3), 50, 60, 25).orderBy("bin_seq").toPandas().prediction
    got = run(pdf)
    assert got[:50].isna().all() and (np.sign(got[50:]) == pdf.label[50:]).mean() > 0.9
    changed = pdf.copy()
    changed.loc[150:, "label"] *= -1
    np.testing.assert_allclose(run(changed)[:150], got[:150])


def test_pca(spark):
    got = learned.pca_ad(spark.createDataFrame(lattice(120)), R, parts=3, train=40, refit=20, z_window=20, z_min=5).orderBy("bin_seq").toPandas().signal
    assert np.allclose(got[:40], 0) and got.abs().max() > 0
