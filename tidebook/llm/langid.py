"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear SVMs inside it.

Training uses a bounded sample: of each language the `SAMPLE` labelled (doc_id, text) pairs of smallest hash,
each once. Features are hashed byte trigrams of the lower-cased whole text, as shares of all its trigrams, so
a prediction doesn't depend on length. Every machine is fitted in a task of its own. A linear score of shares
is the mean of the weights of the trigrams, so scoring a batch is one lookup per byte and model.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import small, stored
from tidebook.llm.vector import texts

BITS = 13
#: Training rows a language; a family has twice as many at most, shared by its languages.
SAMPLE = 600
EPOCHS = 40
BROADCAST_ROWS = 300_000
UNKNOWN = "und"
PIECE = 1 << 19

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he am",
    "indo-aryan": "hi bn ur pa mr gu",
    "sinitic": "zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def families(langs: list[str]) -> dict[str, str]:
    """The family of each language. Of n languages not listed, some sqrt(n) neighbours by name are a family.

    A few of them are families of their own, but many don't make a machine for every two.
    """
    others = sorted(x for x in langs if x not in FAMILY_OF)
    size = 1 if len(others) <= 9 else math.isqrt(len(others))
    return {x: FAMILY_OF[x] for x in langs if x in FAMILY_OF} | {x: f"other {others[i - i % size]}" for i, x in enumerate(others)}


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The hash bucket of each byte trigram. Digits and ASCII punctuation count as spaces."""
    x = FOLD[data].astype(np.uint32)
    code = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


FOLD = np.arange(256, dtype=np.uint8)
FOLD[:97] = 32
FOLD[123:128] = 32
FOLD[65:91] = np.arange(97, 123)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text has, and the share of its trigrams in each."""
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    counts = np.bincount(_trigrams(data), minlength=1 << BITS) if len(data) > 2 else np.zeros(1 << BITS)
    filled = np.flatnonzero(counts)
    return filled.astype(np.uint16), (counts[filled] / max(1, counts.sum())).astype(np.float32)


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear SVM with hinge loss by dual coordinate descent over sparse rows; y is 1 or -1. Returns weights and bias."""
    w, bias, alpha = np.zeros(1 << BITS, np.float32), 0.0, np.zeros(len(rows))
    norms, order = [float(v @ v) + 1 for _, v in rows], np.random.default_rng(seed)
    for _ in range(EPOCHS):
        most = 0.0
        for i in order.permutation(len(rows)):
            at, values = rows[i]
            margin = y[i] * (float(w[at] @ values) + bias)
            step = min(max(alpha[i] - (margin - 1) / norms[i], 0.0), cost) - alpha[i]
            if step:
                alpha[i] += step
                w[at] += np.float32(step * y[i]) * values
                bias += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3 * cost:
            break
    return w, bias


class Model:
    """Pairs of classes with a weight vector each: families against each other, then languages of one family."""

    def __init__(self, langs: list[str], scale: float = 30.0):
        self.langs, self.scale, self.family = langs, scale, families(langs)
        groups = sorted(set(self.family.values()))
        self.jobs = [(f"family {a}", f"family {b}") for a, b in combinations(groups, 2)]
        for f in groups:
            self.jobs += [(f"lang {a}", f"lang {b}") for a, b in combinations(sorted(x for x in langs if self.family[x] == f), 2)]
        self.pairs = [(a.split(" ", 1)[1], b.split(" ", 1)[1]) for a, b in self.jobs]
        self.weights = [np.zeros(1 << BITS, np.float32) for _ in self.jobs]
        self.bias, self.spread = [0.0] * len(self.jobs), [1.0] * len(self.jobs)

    def fit_pair(self, job: int, x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, float, float]:
        """Weights, bias and typical margin of one machine."""
        x = [(at, values * np.float32(self.scale)) for at, values in x]
        w, bias = svm(x, y, job)
        return (w * self.scale).astype(np.float32), bias, float(np.median([abs(float(w[c] @ v) + bias) for c, v in x])) or 1.0

    def choose(self, margins: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Winner of the one-versus-one votes among `names`, and the mean probability of its duels."""
        rows = np.arange(len(margins))
        if len(names) == 1:
            return np.zeros(len(margins), int), np.ones(len(margins))
        won = np.zeros((len(margins), len(names)))
        for k, (a, b) in enumerate(self.pairs):
            if a in names and b in names:
                p = 1 / (1 + np.exp(-np.clip(2 * margins[:, k] / self.spread[k], -30, 30)))
                won[:, names.index(a)] += (p >= 0.5) + 1e-3 * p
                won[:, names.index(b)] += (p < 0.5) + 1e-3 * (1 - p)
        best = won.argmax(axis=1)
        score = np.zeros(len(margins))
        for k, (a, b) in enumerate(self.pairs):
            if a in names and b in names:
                p = 1 / (1 + np.exp(-np.clip(2 * margins[:, k] / self.spread[k], -30, 30)))
                score += np.where(best == names.index(a), p, 0) + np.where(best == names.index(b), 1 - p, 0)
        return best[rows], score / (len(names) - 1)

    def predict(self, batch: list[bytes]) -> tuple[list[str], np.ndarray]:
        margins = np.zeros((len(batch), len(self.pairs)))
        i = 0
        while i < len(batch):  # texts of about a piece at once, one longer text alone and piece by piece
            j, n = i, 0
            while j < len(batch) and (j == i or n + len(batch[j]) < PIECE):
                n += len(batch[j]) + 2
                j += 1
            parts = [b" " + x + b" " for x in batch[i:j]]
            if j == i + 1:
                sums, count = np.zeros(len(self.pairs)), len(parts[0]) - 2
                for at in range(0, count, PIECE):
                    grams = _trigrams(np.frombuffer(parts[0], np.uint8)[at : at + PIECE + 2])
                    sums += [w[grams].sum(dtype=np.float64) for w in self.weights]
                margins[i] = sums / max(1, count)
            else:
                lengths = np.array([len(p) for p in parts])
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                grams = _trigrams(np.frombuffer(b"".join(parts), np.uint8))
                # the two trigrams over the end of each text but the last count for none
                over = np.concatenate([starts[1:] - 2, starts[1:] - 1])
                for k, w in enumerate(self.weights):
                    values = w[grams].astype(np.float64)
                    values[over] = 0
                    ok = np.minimum(starts, max(0, len(values) - 1))
                    margins[i:j, k] = np.where(lengths > 2, np.add.reduceat(values, ok), 0) / np.maximum(1, lengths - 2)
            i = j
        margins += np.array(self.bias)
        groups = sorted(set(self.family.values()))
        chosen, score = self.choose(margins, groups)
        names, scores = np.empty(len(batch), object), np.zeros(len(batch))
        for f, name in enumerate(groups):
            rows = np.flatnonzero(chosen == f)
            if not len(rows):
                continue
            inside = sorted(x for x in self.langs if self.family[x] == name)
            best, p = self.choose(margins[rows], inside)
            names[rows] = [inside[b] for b in best]
            scores[rows] = score[rows] * p
        return list(names), scores


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the doc_id as text is 2 modulo 4. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(x) for x in texts(batch.column(2))]
        columns = [pa.array([x.tobytes() for x in c], pa.binary()) for c in (zip(*found, strict=True) if found else ((), ()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["lang", "h", "buckets", "shares"])


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """Stored: ``lang, h, place`` of the labelled pairs of doc_id and text that train, by hash order in their language.

    The order is that of the hash's upper half, as an unsigned number.
    """
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    keys = stored(rows.select("lang", F.xxhash64("doc_id", "text").alias("h")).distinct(), "langid-keys")
    counts = small(stored(keys.groupBy("lang").agg(F.count("*").alias("n")), "langid-counts"), BROADCAST_ROWS)
    # a cutoff that somewhat more than the sample pass, so that a language's rows needn't meet in one task to be ordered
    share = (sample + 5 * sample**0.5) / F.col("n")
    near = keys.join(counts, "lang").filter(F.shiftrightunsigned("h", 32) < share * (1 << 32)).select("lang", "h")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 32), "h"))
    return stored(near.withColumn("place", place).filter(F.col("place") <= sample), "langid-sample")


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on the bounded sample described above; None without any labelled row.

    Rows equal in doc_id and text count once, so copies don't fill the sample. The driver has the names of
    the languages and the fitted machines, never features.
    """
    spark, top = docs.sparkSession, sampled(docs, sample)
    langs = sorted(r["lang"] for r in top.select("lang").distinct().collect())
    if not langs:
        return None
    model = Model(langs)
    rows = docs.filter(~held_out(F.col("doc_id"))).select("lang", F.xxhash64("doc_id", "text").alias("h"), F.lower("text").alias("text"))
    rows = rows.join(small(top.select("lang", "h"), BROADCAST_ROWS), ["lang", "h"], "left_semi")
    counted = rows.mapInArrow(_counted, "lang string, h bigint, buckets binary, shares binary").dropDuplicates(["lang", "h"]).join(small(top, BROADCAST_ROWS), ["lang", "h"])
    size = Counter(model.family.values())
    classes = [(x, c, most) for x in langs for c, most in ((f"lang {x}", sample), (f"family {model.family[x]}", -(-2 * sample // size[model.family[x]])))]
    sides = [(c, i, y) for i, (a, b) in enumerate(model.jobs) for c, y in ((a, 1.0), (b, -1.0))]
    if not sides:
        return model
    named = small(spark.createDataFrame(classes, "lang string, cls string, most int"), BROADCAST_ROWS)
    jobs = small(spark.createDataFrame(sides, "cls string, job int, y double"), BROADCAST_ROWS)
    of = counted.join(named, "lang").filter("place <= most").join(jobs, "cls").select("job", "lang", "h", "y", "buckets", "shares")

    def fitted(df):
        df = df.sort_values(["lang", "h"])
        x = [(np.frombuffer(b, np.uint16), np.frombuffer(v, np.float32)) for b, v in zip(df["buckets"], df["shares"], strict=True)]
        w, bias, spread = model.fit_pair(int(df["job"].iloc[0]), x, df["y"].to_numpy())
        return pd.DataFrame({"job": df["job"].iloc[:1], "weights": [w.tobytes()], "bias": [bias], "spread": [spread]})

    for r in of.groupBy("job").applyInPandas(fitted, "job int, weights binary, bias double, spread double").collect():
        model.weights[r["job"]], model.bias[r["job"]], model.spread[r["job"]] = np.frombuffer(r["weights"], np.float32), r["bias"], r["spread"]
    return model


def _predicted(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    """Batches with the text and the letter test last, which the prediction and its score replace."""
    for batch in batches:
        n = batch.num_columns - 2
        known = [i for i, letters in enumerate(batch.column(n + 1).to_pylist()) if letters and model is not None]
        names: list[str] = [UNKNOWN] * batch.num_rows
        scores = np.zeros(batch.num_rows)
        if known:
            all_texts = texts(batch.column(n))
            found, scores[known] = model.predict([all_texts[i] for i in known])
            for i, name in zip(known, found, strict=True):
                names[i] = name
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [f"c{i}" for i in range(n + 2)])


def _languages(batches: Iterator[pa.Array], model: Model | None) -> Iterator[pa.Array]:
    for text in batches:
        there = [i for i, known in enumerate(text.is_valid().to_pylist()) if known and model is not None]
        names: list[str] = [UNKNOWN] * len(text)
        if there:
            every = texts(text)
            for i, name in zip(there, model.predict([every[i] for i in there])[0], strict=True):
                names[i] = name
        yield pa.array(names, pa.string())


def _scored(docs: DataFrame, model: Model | None, columns: list[Column]) -> DataFrame:
    """The columns, by position c0, c1, ..., then the prediction and its score."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    wide = docs.select(*columns, F.lower("text"), letters)
    wide = wide.toDF(*[f"c{i}" for i in range(len(columns) + 2)])
    kinds = [f"c{i} {wide.schema[i].dataType.simpleString()}" for i in range(len(columns))]
    return wide.mapInArrow(lambda b: _predicted(b, model), ", ".join([*kinds, f"c{len(columns)} string", f"c{len(columns) + 1} double"]))


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of `docs`: ``doc_id, held_out, lang_pred, score``.

    A text that is null or has no letter is `und` with score 0, as is every text without a model (an empty
    or unlabelled table). Equal texts get equal predictions; further columns are ignored.
    """
    return _scored(docs, model, [F.col("doc_id"), held_out(F.col("doc_id"))]).toDF("doc_id", "held_out", "lang_pred", "score")


def languages_only(docs: DataFrame) -> DataFrame:
    """The documents that have a language, with their own columns: those predicted `und` go."""
    n, model = len(docs.columns), train(docs)

    @F.arrow_udf("string")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _languages(batches, model)

    # Python gets the text alone, and only its language comes back; a text without a letter is none
    wide = docs.toDF(*[f"c{i}" for i in range(n)])
    text = F.col(f"c{docs.columns.index('text')}")
    lang = language(F.when(text.rlike(r"\p{L}"), F.lower(text)))
    return wide.withColumn("_lang", lang).filter(F.col("_lang") != UNKNOWN).drop("_lang").toDF(*docs.columns)
