import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import langid as L


@pytest.fixture(scope="module")
def model(spark, docs):
    return L.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.identified(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    r = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("ok"), F.count("*").alias("n")).first()
    assert r.n > 150 and r.ok > 0.97


def test_odd_rows(odd, none, model):
    rows = L.identified(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id != 18:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert L.identified(none, model).count() == 0
    assert L.train(none) is None
    assert {r.lang_pred for r in L.identified(odd, None).collect()} == {"und"}


def test_rerun_and_equal_texts(odd, model):
    a, b = (sorted(map(str, L.identified(df, model).collect())) for df in (odd, odd.repartition(1)))
    assert a == b


def test_stage_keeps_documents(docs, odd, none):
    kept = L.languages_only(docs)
    assert kept.columns == docs.columns
    assert kept.count() == docs.filter(r"text rlike '\\p{L}'").count()
    assert L.languages_only(odd).count() == odd.filter("lang is not null and true").sparkSession.createDataFrame(odd.collect(), odd.schema).filter(r"text rlike '\\p{L}'").count()
    assert L.languages_only(none).count() == 0


def test_languages_of_several_families(spark):
    words = {"en": "the and was that with", "de": "der und nicht das mit", "nl": "het een niet van met", "fr": "les pas dans une avec", "ru": "это как она был все"}
    rows = [(i, " ".join(f"{w}{i % 7}" for w in words[lang].split()), lang) for i, lang in enumerate(list(words) * 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = L.identified(df, L.train(df)).join(df.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() >= 0.9 * found.count() > 0


def random_words(n, seed=0):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)) for _ in range(n)]


def test_many_languages(spark, monkeypatch):
    """300 languages, most of them not listed, with every join shuffled."""
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    words = random_words(300)
    rows = [(i * 300 + j, f"{w} {i}", f"x{j:03}" if j > 3 else ["en", "de", "fr", "ru"][j]) for i in range(6) for j, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = L.train(df, sample=4)
    assert len(model.langs) == 300 and len(model.jobs) < 300**2 / 10
    found = L.identified(df, model).join(df.select("doc_id", "lang"), "doc_id")
    assert found.filter("lang = lang_pred").count() >= 0.9 * len(rows)


@pytest.mark.parametrize("doc_id", [0, 1, 3, 5, 7])
def test_one_doc_id_for_all(spark, doc_id):
    rows = [(doc_id, f"the and was that with {i}" if i % 2 else f"der und nicht das mit {i}", "en" if i % 2 else "de") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = L.train(df)
    if zlib.crc32(str(doc_id).encode()) % 4 == 2:
        assert model is None
    else:
        assert {r.lang_pred for r in L.identified(df.filter("lang = 'en'"), model).collect()} == {"en"}
        assert {r.lang_pred for r in L.identified(df.filter("lang = 'de'"), model).collect()} == {"de"}


def test_copies_count_once(spark):
    """Rows equal in doc_id and text don't crowd others out of the sample."""
    rows = [(1, "the and was that with", "en")] * 3000 + [(i, f"the and {w}", "en") for i, w in enumerate(random_words(50), 10)] + [(i, f"der und {w}", "de") for i, w in enumerate(random_words(50, 1), 100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    counts = {r["lang"]: r["count"] for r in L.sampled(df, 20).groupBy("lang").count().collect()}
    assert counts == {"en": 20, "de": 20}


def test_prediction_by_hand(docs, model):
    """Each prediction is that of the machines applied one by one to the text's trigram counts."""
    def brute(text):
        data = b" " + text.lower().encode() + b" "
        grams = Counter(L._trigrams(np.frombuffer(data, np.uint8)).tolist())
        margin = {p: sum(n * float(w[g]) for g, n in grams.items()) / (len(data) - 2) + b for p, w, b in zip(model.jobs, model.weights, model.bias, strict=True)}

        def winner(level, names):
            score = {n: 0.0 for n in names}
            for (a, b), k in zip(model.jobs, range(len(model.jobs)), strict=True):
                if a.startswith(level) and a.split(" ", 1)[1] in score and b.split(" ", 1)[1] in score:
                    p = 1 / (1 + math.exp(-max(-30, min(30, 2 * margin[a, b] / model.spread[k]))))
                    score[a.split(" ", 1)[1]] += (p >= 0.5) + 1e-3 * p
                    score[b.split(" ", 1)[1]] += (p < 0.5) + 1e-3 * (1 - p)
            return max(sorted(score), key=score.get)

        family = winner("family", sorted(set(model.family.values())))
        return winner("lang", [x for x in model.langs if model.family[x] == family])

    got = {r.doc_id: r.lang_pred for r in L.identified(docs, model).collect()}
    for r in docs.limit(60).collect():
        if r.text and any(c.isalpha() for c in r.text):
            assert got[r.doc_id] == brute(r.text)


def test_python_gets_no_more_than_the_text(docs):
    """The pipeline's stage keeps all columns in the JVM: Python takes one column and gives one back."""
    kept = L.languages_only(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    want = {r.doc_id for r in L.identified(docs, L.train(docs)).filter("lang_pred <> 'und'").collect()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
