import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidebook.llm import resample as R

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]


def brute(rows, target, buckets=R.BUCKETS, min_words=R.MIN_WORDS, percent=R.PERCENT, seed=R.SEED):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for into, some in ((s, [x[1] for x in rows]), (t, target)):
        for text in some:
            for f in features(text)[1]:
                into[bucket(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + buckets) / ((a + 1) * (T + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for doc, text in rows:
        words, fs = features(text)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    n = len(able) * percent // 100
    ranks = [(*x, i + 1 if i < n else None) for i, x in enumerate(able)] + [(*x, None) for x in out if x[1] < min_words]
    return sorted(ranks, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=str)


def test_states_are_crcs():
    rng = random.Random(3)
    words = [bytes(rng.randrange(97, 123) for _ in range(n)) for n in [1, 2, 3, 4, 7, 8, 31, 255, 1000, 70_000]]
    trie = R.Trie()
    nodes = trie.numbered(words)
    first, second = (x.ravel() for x in np.meshgrid(nodes, nodes))
    want = [zlib.crc32(words[a] + b" " + words[b]) for a, b in zip(first, second, strict=True)]
    assert trie.pair_states(first, second).tolist() == want


def test_documents(spark, docs, small_dir):
    target = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert got(R.resampled(docs, target)) == want
    assert sum(x[5] is not None for x in want) > 20


@pytest.mark.parametrize("block, trie_words", [(5, 3), (64, 1000)])
def test_small_blocks_and_tries(spark, monkeypatch, block, trie_words):
    """Blocks that end within texts, and tries emptied after each, change nothing."""
    rng = random.Random(block)
    text = lambda: " ".join(rng.choice(["a", "B", "çé", "x1", "longer"]) + rng.choice(["", "", ",", " -"]) for _ in range(rng.randint(0, 40)))
    rows = [(i, rng.choice([None, "", text(), text(), text()])) for i in range(50)]
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "TRIE_WORDS", trie_words)
    import pyarrow as pa

    gain = np.arange(97) - 40
    batches = [pa.RecordBatch.from_pydict({"doc_id": [x[0] for x in part], "text": [x[1] for x in part]}) for part in (rows[:7], rows[7:8], rows[8:])]
    total = np.zeros(97, int)
    for out in R.bucket_counts(97)(iter([b.select(["text"]) for b in batches])):
        total[out["bucket"].to_numpy()] += out["n"].to_numpy()
    want, scores = np.zeros(97, int), []
    for doc, t in rows:
        words, fs = features(t)
        at = [zlib.crc32(f.encode()) % 97 for f in fs]
        np.add.at(want, at, 1)
        scores.append((doc, len(words), len(fs), sum(int(gain[b]) for b in at) // len(fs) if fs else 0))
    assert total.tolist() == want.tolist()
    assert [tuple(r.values()) for out in R.walked(gain)(iter(batches)) for r in out.to_pylist()] == scores


def test_odd_rows(spark, odd, none, docs):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got_rows, want = got(R.resampled(odd, docs, min_words=5, percent=60)), brute(rows, [r.text for r in docs.collect()], min_words=5, percent=60)
    assert got_rows == want
    assert R.resampled(none, docs).count() == 0
    assert got(R.resampled(odd, none)) == brute(rows, [])
    assert R.drawn_documents(odd, R.resampled(odd, docs, min_words=5, percent=60)).columns == odd.columns
