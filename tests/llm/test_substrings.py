import hashlib
import random
from collections import Counter

import pytest

from tidebook.llm import substrings as S


def brute(rows, width):
    seen = Counter()  # of hashes of the strings, which take less room
    for _, t in rows:
        seen.update(hash(t[i : i + width]) for i in range(len(t) - width + 1))
    out = []
    for d, t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if seen[hash(t[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **k):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in S.deduplicated(df, **k).collect()), key=str)


@pytest.mark.parametrize("seed, width, reach, block", [(1, 20, 12, 4), (2, 33, 20, 8), (3, 9, 5, 2), (4, 40, 30, 16)])
def test_small_widths(spark, seed, width, reach, block):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(10, 80))) for _ in range(8)]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 8))) for _ in range(40)]
    texts += ["a" * 200, "ab" * 90, "é" * 60, texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert got(df, width=width, reach=reach, block=block) == brute([(i, t.encode()) for i, t in enumerate(texts)], width)


def test_documents(docs):
    some = docs.filter("length(text) < 20000")
    assert got(some) == brute([(r.doc_id, (r.text or "").encode()) for r in some.collect()], S.WIDTH)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.collect() if len(r.text or "") < 60_000]
    short = odd.filter("text is null or length(text) < 60000")
    assert got(short) == brute(rows, S.WIDTH)
    assert S.deduplicated(none).count() == 0
    assert S.deduplicated(odd).count() == odd.count()
