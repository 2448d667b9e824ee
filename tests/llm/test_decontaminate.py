import hashlib
import re

import pytest

from tidebook.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, t in items:
            v = words(t)
            n = min(window, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    ids.add(str(item_id)) if item_id is not None else None
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark, odd):
    texts = [r.text for r in odd.filter("doc_id in (1, 7, 12, 13)").orderBy("doc_id").collect()]
    rows = [(1, " ".join(texts[0].split()[5:30])), (2, " ".join(texts[1].split()[100:112])), (3, "one"), (4, None), (5, ""), (6, "a b"), (7, " ".join(texts[2].split()[:9])), (7, "never there at all ever"), (None, " ".join(texts[1].split()[-11:])), (8, "straße naïve €5"), (9, "x " * 12)]
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("window", [3, 10])
def test_brute_force(spark, odd, items, window):
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in D.contamination(odd, items, window).collect()), key=str)
    want = brute([(r.doc_id, r.text) for r in odd.collect()], [tuple(r) for r in items.collect()], window)
    assert got == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)


def test_only_clean_documents_stay(odd, items):
    kept = D.decontaminated(odd, items)
    want = [(r.doc_id, r.text) for r in odd.collect() if not brute([(r.doc_id, r.text)], [tuple(i) for i in items.collect()], 10)[0][5]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert kept.columns == odd.columns


def test_empty_tables(spark, odd, none, items):
    assert D.contamination(none, items).count() == 0
    assert D.contamination(odd, items.filter("false")).filter("contaminated").count() == 0
    assert D.decontaminated(odd, items.filter("false")).count() == odd.count()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha filler beta filler gamma"), (2, "alpha " + "filler " * 40 + "beta gamma"), (3, "gamma beta alpha"), (4, "alpha beta")], "doc_id bigint, text string")
    terms = D.item_terms(spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string"))
    index = D.build_index(docs, terms)
    found = D.proximity_matches(index, terms, 6).join(D.document_lengths(index), "row")
    assert {r.doc_id for r in found.collect()} == {1, 3}
