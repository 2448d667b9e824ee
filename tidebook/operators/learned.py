"""Walk-forward models over per-bin features: each stretch of bins is predicted by a model of the bins before it.

A stretch between two refits is a chunk, its training window the halo: Spark deals out one task per refit, with
bounded rows in each. Windows trail (`train` bins); a window that grows with the series would have no bound.
Models are small numpy fits without randomness. Labels look ahead by up to their hold; with `purge` = hold
only labels that are known when the stretch begins are trained on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions import kernels
from tidebook.functions.chunks import apply_chunks
from tidebook.operators.signals import asymmetry, bands_within, side_mean

Fit = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], np.ndarray]]


def standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, std = x.mean(axis=0), x.std(axis=0)
    return mean, np.where(std > 1e-12, std, 1.0)


def knn(k: int = 11) -> Fit:
    """Share of rising less falling among the k nearest rows, weighted by one over the distance."""
    def fit(x: np.ndarray, y: np.ndarray):
        mean, std = standard(x)
        known = (x - mean) / std
        squares = (known * known).sum(axis=1)

        def predict(q: np.ndarray) -> np.ndarray:
            q, out = (q - mean) / std, np.zeros(len(q))
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                d2 = np.maximum(squares + (part * part).sum(axis=1)[:, None] - 2 * part @ known.T, 0)
                n = min(k, len(known))
                near = np.argsort(d2, axis=1, kind="stable")[:, :n]
                w = 1 / (np.sqrt(np.take_along_axis(d2, near, axis=1)) + 1e-9)
                out[at : at + 256] = (w * np.sign(y[near])).sum(axis=1) / w.sum(axis=1)
            return out

        return predict

    return fit


def linear_svm(cost: float, balanced: bool, rounds: int = 30) -> Fit:
    """Decision values of a linear SVM on standardised features, by dual coordinate descent."""
    def fit(x: np.ndarray, y: np.ndarray):
        mean, std = standard(x)
        z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
        s = np.sign(y).astype(float)
        share = {v: max(1, int((s == v).sum())) for v in (-1.0, 1.0)}
        bound = np.array([cost * (len(s) / (2 * share[v]) if balanced else 1.0) for v in s])
        w, alpha, norms, order = np.zeros(z.shape[1]), np.zeros(len(z)), (z * z).sum(axis=1), np.random.default_rng(0)
        for _ in range(rounds):
            for i in order.permutation(len(z)):
                step = min(max(alpha[i] - (s[i] * (w @ z[i]) - 1) / norms[i], 0.0), bound[i]) - alpha[i]
                if step:
                    alpha[i] += step
                    w += step * s[i] * z[i]
        return lambda q: np.hstack([(q - mean) / std, np.ones((len(q), 1))]) @ w

    return fit


def boosted_stumps(rounds: int = 60, rate: float = 0.1, bins: int = 32, patience: int = 10) -> Fit:
    """Probability of rising by gradient boosting of one-split trees over quantile bins; the last fifth stops it early."""
    def fit(x: np.ndarray, y: np.ndarray):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        coded = np.column_stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)])
        t, cut = (y > 0).astype(float), max(1, len(y) * 4 // 5)
        base = np.log((t[:cut].mean() + 1e-6) / (1 - t[:cut].mean() + 1e-6))
        f, trees, best, since, keep = np.full(len(y), base), [], np.inf, 0, 0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f[:cut]))
            g, h = t[:cut] - p, p * (1 - p)
            top = (0.0, None)
            for j in range(x.shape[1]):
                gs, hs = (np.cumsum(np.bincount(coded[:cut, j], v, bins)) for v in (g, h))
                gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1)
                b = int(gain[:-1].argmax())
                if gain[b] > top[0]:
                    top = (gain[b], (j, b, gs[b] / (hs[b] + 1), (gs[-1] - gs[b]) / (hs[-1] - hs[b] + 1)))
            if top[1] is None:
                break
            j, b, low, high = top[1]
            trees.append(top[1])
            f += rate * np.where(coded[:, j] <= b, low, high)
            q = np.clip(1 / (1 + np.exp(-f[cut:])), 1e-9, 1 - 1e-9)
            loss = -np.mean(t[cut:] * np.log(q) + (1 - t[cut:]) * np.log(1 - q)) if cut < len(y) else 0.0
            if loss < best - 1e-6:
                best, since, keep = loss, 0, len(trees)
            else:
                since += 1
                if since >= patience:
                    break
        trees = trees[: max(1, keep)]

        def predict(q: np.ndarray) -> np.ndarray:
            out = np.full(len(q), base)
            for j, b, low, high in trees:
                out += rate * np.where(np.searchsorted(edges[j], q[:, j], side="right") <= b, low, high)
            return 1 / (1 + np.exp(-out))

        return predict

    return fit


def walk_forward(per_bin: DataFrame, label: str, fit: Fit, least: int, train: int, refit: int, purge: int = 0) -> DataFrame:
    """``bin_seq, prediction``: null before `least` bins are known or where the window has one kind of label only.

    All columns but ``bin_seq`` and the label are features; NaN and infinities count as 0. Rows with label 0 train no model.
    """
    names = [c for c in per_bin.columns if c not in ("bin_seq", label)]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.nan_to_num(pdf[names].to_numpy(dtype=np.float64), nan=0.0, posinf=0.0, neginf=0.0)
        own, y, out = pdf["_own"].to_numpy(), pdf[label].to_numpy(), np.full(len(pdf), np.nan)
        start = int(pdf["bin_seq"].to_numpy()[own].min()) if own.any() else 0
        use = ~own & (y != 0) & (pdf["bin_seq"].to_numpy() < start - purge)
        if start >= least and len(set(y[use])) > 1:
            out[own] = fit(x[use], y[use])(x[own])
        return pd.DataFrame({"prediction": out})

    df = apply_chunks(per_bin, [], "bin_seq", train, kernel, "prediction double", chunk=refit)
    return df.select("bin_seq", F.when(~F.isnan("prediction"), F.col("prediction")).alias("prediction"))


# ---- features


def band_features(columns: list[str], radius: int) -> list:
    return [asymmetry(c, lo, hi, "pull" in c).alias(f"{c}_{lo}") for c in columns for lo, hi in bands_within(radius)]


def with_time(per_bin: DataFrame, bins: DataFrame, slopes: list[str], window: int = 50, returns: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Adds slopes of features, and returns, spread and skew of the mid price."""
    joined = per_bin.join(bins.select("bin_seq", "mid_price"), "bin_seq")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        mid, out = pdf["mid_price"], {}
        for c in slopes:
            out[f"slope_{c}"] = kernels.slope(pdf[c].to_numpy(), window)
        for n in returns:
            out[f"return_{n}"] = mid.diff(n)
        out["spread"] = mid.rolling(window, min_periods=2).std()
        out["skew"] = mid.rolling(window, min_periods=3).skew()
        return pd.DataFrame(out).fillna(0.0)

    added = [f"slope_{c}" for c in slopes] + [f"return_{n}" for n in returns] + ["spread", "skew"]
    return apply_chunks(joined, [], "bin_seq", window + max(returns), kernel, ", ".join(f"`{c}` double" for c in added)).drop("mid_price")


def profile(column: str, radius: int) -> list:
    return [F.sum(F.when(F.col("k") == k, F.col(column)).otherwise(0.0)).alias(f"{column}_{k + radius}") for k in range(-radius, radius + 1)]


def gbm_mf(lattice: DataFrame, bins: DataFrame, labels: DataFrame, radius: int, least: int = 2400, train: int = 12_000, refit: int = 600, purge: int = 0) -> DataFrame:
    """Many band features, their slopes and price statistics; boosted trees; probability of rising."""
    bands = band_features(["v_add", "v_pull", "a_add", "a_pull", "j_add", "j_pull"], radius)
    near = [F.sum(F.when(F.col("k") == 0, F.col(c))).alias(f"spot_{c}") for c in ("pressure_variant", "vacuum_variant")]
    df = lattice.groupBy("bin_seq").agg(*bands, *near)
    df = with_time(df, bins, [c for c in df.columns if c not in ("bin_seq", "spot_pressure_variant", "spot_vacuum_variant")])
    return walk_forward(df.join(labels, "bin_seq"), "label", boosted_stumps(), least, train, refit, purge)


def xgb_snap(lattice: DataFrame, bins: DataFrame, labels: DataFrame, radius: int, least: int = 3000, train: int = 12_000, refit: int = 600, purge: int = 0) -> DataFrame:
    """The whole profile of pressure, vacuum and their difference; boosted trees; probability of rising."""
    cells = lattice.withColumn("net", F.col("pressure_variant") - F.col("vacuum_variant"))
    df = cells.groupBy("bin_seq").agg(*[x for c in ("pressure_variant", "vacuum_variant", "net") for x in profile(c, radius)])
    return walk_forward(with_time(df, bins, []).join(labels, "bin_seq"), "label", boosted_stumps(), least, train, refit, purge)


def knn_cl(lattice: DataFrame, bins: DataFrame, labels: DataFrame, radius: int, k: int = 11, least: int = 1800, train: int = 12_000, refit: int = 300, purge: int = 0) -> DataFrame:
    """Nearest neighbours in band features and returns; share of rising less falling."""
    df = lattice.groupBy("bin_seq").agg(*band_features(["v_add", "v_pull", "v_fill", "pressure_variant", "vacuum_variant"], radius))
    return walk_forward(with_time(df, bins, [], returns=(1, 5, 20, 50)).join(labels, "bin_seq"), "label", knn(k), least, train, refit, purge)


def lsvm_der(lattice: DataFrame, bins: DataFrame, labels: DataFrame, radius: int, least: int = 1200, train: int = 12_000, refit: int = 600, purge: int = 0) -> DataFrame:
    """Velocities, accelerations and jerks by band; linear SVM; decision value."""
    df = lattice.groupBy("bin_seq").agg(*band_features([f"{d}_{x}" for d in "vaj" for x in ("add", "pull")], radius))
    return walk_forward(with_time(df, bins, []).join(labels, "bin_seq"), "label", linear_svm(1.0, False), least, train, refit, purge)


def svm_sp(lattice: DataFrame, bins: DataFrame, labels: DataFrame, radius: int, least: int = 1200, train: int = 12_000, refit: int = 300, purge: int = 0) -> DataFrame:
    """Spatial means of pressure and vacuum by side and band; balanced linear SVM; decision value."""
    sides = [side_mean(c, lo, hi, s).alias(f"{c}_{lo}_{'ba'[s > 0]}") for c in ("pressure_variant", "vacuum_variant", "v_add", "v_pull") for lo, hi in bands_within(radius) for s in (-1, 1)]
    df = lattice.groupBy("bin_seq").agg(*sides)
    return walk_forward(df.join(labels, "bin_seq"), "label", linear_svm(0.1, True), least, train, refit, purge)


def pca_ad(lattice: DataFrame, radius: int, parts: int = 10, train: int = 600, refit: int = 100, z_window: int = 300, z_min: int = 75) -> DataFrame:
    """``bin_seq, signal``: how far a bin's net profile lies from the main components of the bins before it, times its direction.

    Distance is the reconstruction error and the Mahalanobis distance within the components; direction is the
    first component's score and the profile's lower less upper mean.
    """
    cells = lattice.withColumn("net", F.col("pressure_variant") - F.col("vacuum_variant"))
    df = cells.groupBy("bin_seq").agg(*profile("net", radius))
    names = [f"net_{i}" for i in range(2 * radius + 1)]

    def project(pdf: pd.DataFrame) -> pd.DataFrame:
        x, own = pdf[names].to_numpy(dtype=np.float64), pdf["_own"].to_numpy()
        known, out = x[~own], np.zeros((len(pdf), 4))
        if len(known) >= train:
            mean, std = standard(known)
            z = (known - mean) / std
            values, vectors = np.linalg.eigh(z.T @ z / len(z))
            n = min(parts, len(names))
            top = vectors[:, ::-1][:, :n]
            top = top * np.where(top[np.abs(top).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0)  # a sign that doesn't depend on the solver
            q = (x[own] - mean) / std
            scores = q @ top
            left = q - scores @ top.T
            far = (scores**2 / np.maximum(values[::-1][:n], 1e-9)).sum(axis=1)
            out[own] = np.column_stack([(left**2).sum(axis=1), far, scores[:, 0], q[:, :radius].mean(axis=1) - q[:, radius + 1 :].mean(axis=1)])
        return pd.DataFrame(out, columns=["error", "far", "first", "side"])

    df = apply_chunks(df, [], "bin_seq", train, project, "error double, far double, first double, side double", chunk=refit).select("bin_seq", "error", "far", "first", "side")

    def blend(pdf: pd.DataFrame) -> pd.DataFrame:
        z = {c: kernels.robust_z(pdf[c].to_numpy(), z_window, z_min) for c in ("error", "far", "first", "side")}
        odd = np.maximum(0.0, 0.5 * z["error"] + 0.5 * z["far"])
        return pd.DataFrame({"signal": odd * (0.6 * np.tanh(z["first"] / 3) + 0.4 * np.tanh(z["side"] / 3))})

    return apply_chunks(df, [], "bin_seq", z_window, blend, "signal double").select("bin_seq", "signal")
