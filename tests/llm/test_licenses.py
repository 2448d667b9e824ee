import random
import re

import numpy as np
import pytest

from tidebook.llm import licenses as L
from tidebook.llm import templates as T


def words(t):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def runs(w):
    n = min(5, len(w))
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if w else []


def contained(text, template):
    """Whether some stretch of at most twice the template's shingles holds 0.8 of them, in a text without other shingles between."""
    have, need = set(runs(words(text))), set(runs(words(template)))
    return len(have & need) >= 0.8 * len(need) - 1e-9 if need else False


def test_documents(docs):
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in L.scanned(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == {n for n, t in T.TEMPLATES.items() if contained(r.text, t)}, r.doc_id
    assert any(got.values())


def test_altered_and_placed_anywhere(spark):
    rng = random.Random(2)
    template = " ".join(f"w{rng.randint(0, 999)}" for _ in range(120))
    noise = lambda n: " ".join(f"n{rng.randint(0, 10**6)}" for _ in range(n))
    texts, want = [], []
    for i in range(60):
        w = template.split()
        for at in rng.sample(range(120), rng.choice([0, 1, 3, 8])):
            w[at] = "changed"
        texts.append(f"{noise(rng.randint(0, 300))} {' '.join(w)} {noise(rng.randint(0, 300))}".strip())
        want.append(contained(" ".join(w), template))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = [r.n_licenses == 1 for r in L.scanned(df, {"T": template, "empty": ""}).orderBy("doc_id").collect()]
    assert got == want and any(want) and not all(want)


def test_odd_rows(odd, none):
    rows = L.scanned(odd).collect()
    assert len(rows) == odd.count() and all(r.n_licenses == 0 for r in rows)
    assert L.scanned(none).count() == 0
    assert L.scanned(odd, {}).count() == odd.count()


@pytest.mark.parametrize("edits", [0, 2, 6, 40])
def test_whole_licenses(spark, edits):
    """Licenses inside other text, with some words altered: found while 0.8 of their shingles are left."""
    rng, rows = random.Random(edits), []
    noise = lambda n: " ".join(f"n{rng.randint(0, 10**6)}" for _ in range(n))
    for name, text in T.TEXTS.items():
        w = text.split()
        for at in rng.sample(range(len(w)), min(edits, len(w))):
            w[at] = "changed"
        rows.append((name, f"{noise(rng.randint(0, 90))} {' '.join(w)} {noise(rng.randint(0, 90))}", contained(" ".join(w), text)))
    got = {r.doc_id: r.licenses.split(",") for r in L.scanned(spark.createDataFrame(rows, "doc_id string, text string, want boolean")).collect()}
    for name, _, want in rows:
        assert (name in got[name]) == want
    assert edits == 2 or {want for _, _, want in rows} == {edits == 0} or edits == 6


def test_blocks_of_templates(spark, docs, odd, monkeypatch):
    """A table beyond one block gives the same rows."""
    some = {n: T.TEMPLATES[n] for n in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "MIT-text")}
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = sorted(map(str, L.scanned(both, some).collect()))
    monkeypatch.setattr(L, "BLOCK_TEMPLATES", 2)
    assert sorted(map(str, L.scanned(both, some).collect())) == want


def test_work_of_classes(monkeypatch):
    """Between short texts a class walks over its own window, not over that of the largest, with 32 bits a shingle."""
    seen, real = {}, L.Class.retrieve
    monkeypatch.setattr(L.Class, "retrieve", lambda self, row: seen.setdefault(self.window, (len(row), row.dtype)) and real(self, row))
    L.Scanner(T.TEMPLATES).scan([L.words(b"one two three four five six")] * 50)
    assert len(seen) > 5 and seen == {w: (50 * (2 + w + 1), np.dtype(np.uint32)) for w in seen}


def test_pieces_and_neighbours(monkeypatch):
    """Cut at any place and beside any texts, every occurrence is found, and by brute force no other window is."""
    rng = random.Random(5)
    bodies = {n: T.TEMPLATES[n] for n in ("MIT", "BSD", "Apache-2.0", "ISC-text", "GPL-3.0-notice")}
    texts = [" ".join(f"n{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 400))) + " " + " . ".join(rng.choices(list(bodies.values()), k=rng.randint(0, 3))) for _ in range(40)]
    scanner = L.Scanner(bodies)
    want = scanner.scan([L.words(t.encode()) for t in texts])
    assert [{name for _, _, name in x} for x in want] == [{n for n, b in bodies.items() if contained(t, b)} for t in texts]
    monkeypatch.setattr(L, "PIECE", 7)
    assert scanner.scan([L.words(t.encode()) for t in texts]) == want


def test_band_keys_meet_as_often_as_they_should():
    """Sets of a class's least similarity share a band's key with the probability that its number of bands is made for."""
    rng, c = np.random.default_rng(3), L.Class(128)
    meets, trials, size, common = 0, 400, 160, 52
    for _ in range(trials):
        every = rng.integers(0, 1 << 32, 2 * size - common, dtype=np.uint32)
        one, other = every[:size], every[size - common :]
        meets += sum(int(a[0] == b[0]) for a, b in zip(c.keys(one[:, None], 1), c.keys(other[:, None], 1), strict=True))
    want = (common / (2 * size - common)) ** c.rows
    assert abs(meets / trials / c.bands - want) < 0.1 * want
