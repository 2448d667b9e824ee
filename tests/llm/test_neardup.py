import random
import re

import numpy as np
import pytest

from tidebook.llm import neardup as N
from tidebook.llm import vector

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows, size):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in groups[root(i)] if x is not None]
        c = d if not sets[i] else min(known, default=None)
        out.append((d, len(sets[i]), c, not sets[i] or (d is not None and d == c)))
    return sorted(out, key=str), sets, [root(i) for i in range(len(rows))]


def got(df, size):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in N.grouped(df, size).collect()), key=str)


def near_copies(seed, n):
    """Chains and stars of altered copies, so that links form large components and near misses."""
    rng, texts = random.Random(seed), []
    for _ in range(n):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, 12)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 99)}"
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size, seed", [(2, 1), (5, 2), (2, 3)])
def test_brute_force(spark, size, seed):
    rows = near_copies(seed, 40)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert got(df, size) == brute(rows, size)[0]


@pytest.mark.parametrize("size", [2, 5])
def test_documents(docs, size):
    assert got(docs, size) == brute([(r.doc_id, r.text) for r in docs.collect()], size)[0]


def test_odd_rows(odd, none):
    assert got(odd, 2) == brute([(r.doc_id, r.text) for r in odd.collect()], 2)[0]
    assert N.grouped(none).count() == 0


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_stage_keeps_one_of_each_group(request, which):
    df = request.getfixturevalue(which)
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    out = N.deduplicated(df)
    assert out.columns == df.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    _, sets, roots = brute(rows, 5)
    groups = {r for r, s in zip(roots, sets, strict=True) if s}
    assert len(kept) == len(groups) + sum(not s for s in sets)
    place = {x: i for i, x in enumerate(rows)}
    assert {roots[place[x]] for x in kept if sets[place[x]]} == groups
    for x in kept:
        mates = [rows[i][0] for i in range(len(rows)) if roots[i] == roots[place[x]] and rows[i][0] is not None]
        assert not sets[place[x]] or x[0] == min(mates, default=None)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    s = vector.super_minhash([np.unique(a), np.unique(b)], N.REGISTERS)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.1


def altered(seed, n, edits):
    """One long base, many copies with `edits` altered words each, and texts that share a passage with it."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 300)}" for _ in range(120)]
    texts = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(*edits)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 300)}"
        texts.append(" ".join(words))
        texts.append(" ".join(base[:30] + [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(1, 60))]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("many", [0, 64])
def test_one_bucket_of_many_components(spark, monkeypatch, many):
    """Copies on either side of the threshold share buckets; with 0, rounds of leaders come before all pairs."""
    monkeypatch.setattr(N, "MANY_PAIRS", many)
    rows = altered(7, 120, (1, 16))
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 2) == brute(rows, 2)[0]


def test_altered_copies_make_few_pairs(spark, monkeypatch):
    """Copies that can't be linked don't meet: pairs grow with the texts, not with their square."""
    pairs = compared(monkeypatch)
    rows = altered(3, 300, (10, 24))
    N.grouped(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).count()
    assert sum(pairs) < 5 * len(rows)


def compared(monkeypatch):
    """A list that gets the number of pairs of every comparison."""
    pairs = []
    for name in ("confirmed", "linked_by_deltas"):
        real = getattr(N, name)
        monkeypatch.setattr(N, name, lambda p, s, real=real: pairs.append(p.count()) or real(p, s))
    return pairs


@pytest.mark.parametrize("n", [150, 300])
def test_copies_just_too_far_apart_make_few_pairs(spark, monkeypatch, n):
    """Five altered words of 120 each: no two copies are linked, though all have most of the base in common."""
    pairs, rng, rows = compared(monkeypatch), random.Random(n), []
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(120), 5):
            words[at] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string"), 2) == brute(rows, 2)[0]
    assert sum(pairs) < 5 * n


@pytest.mark.parametrize("levels, seed", [({}, 11), ({2: 25}, 12), ({2: 6, 4: 5}, 13), (N.LEVELS, 14)])
def test_shared_differences_link(spark, monkeypatch, levels, seed):
    """Copies too far from the base and from its nearest copy are linked by alterations that they share, or just not."""
    monkeypatch.setattr(N, "LEVELS", levels)
    rng, rows = random.Random(seed), []
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
    for _ in range(12):
        common = {rng.randrange(80): f"s{rng.randint(0, 10**6)}" for _ in range(rng.randint(4, 9))}
        for _ in range(rng.randint(2, 5)):
            words = list(base)
            for at, w in (common | {rng.randrange(80): f"x{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 4))}).items():
                words[at] = w
            rows.append((len(rows), " ".join(words)))
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), 2) == brute(rows, 2)[0]


def test_classes_far_from_their_group_have_few_keys(spark, monkeypatch):
    """A far class is linked only with classes that are as far, so few of its shingles come into question; twins show that no link is lost."""
    keys, real = [], N.prefixes
    monkeypatch.setattr(N, "prefixes", lambda *a: keys.append(real(*a)) or keys[-1])
    rng, rows = random.Random(21), []
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    for i in range(140):
        words = list(base)
        for at in rng.sample(range(150), 4 + i % 7):
            words[at] = f"x{rng.randint(0, 10**6)}"
        rows.append((len(rows), " ".join(words)))
        if i % 4 == 0:  # of about the similarity that links
            for at in rng.sample(range(150), rng.randint(2, 4)):
                words[at] = f"y{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    expected = brute(rows, 5)[0]
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), 5) == expected
    assert sum(not r[3] for r in expected) > 10
    assert 0 < keys[0].count() < 20 * len(rows)


@pytest.mark.parametrize("bound, value", [("BROADCAST_ROWS", 0), ("FOREST_NODES", 2)])
def test_bounds_change_nothing(spark, monkeypatch, bound, value):
    monkeypatch.setattr(N, bound, value)
    rows = near_copies(9, 15)
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 2) == brute(rows, 2)[0]


def test_no_link_is_lost(spark):
    """Recall of links against brute force, over copies of just the similarity that makes a link."""
    rng, texts = random.Random(2), []
    for _ in range(250):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(101)]
        texts += [" ".join(words), " ".join(words[:90] + [f"w{rng.randint(0, 10**6)}" for _ in range(11)])]
    rows = list(enumerate(texts))
    found = got(spark.createDataFrame(rows, "doc_id bigint, text string"), 2)
    assert found == brute(rows, 2)[0] and sum(not r[3] for r in found) == 250


def test_long_words_with_equal_sums_of_powers_differ():
    for n in (1024, 4096):
        a = "".join("ab"[i.bit_count() & 1] for i in range(n))
        b = a.translate(str.maketrans("ab", "ba"))
        words = vector.words_of(f"{a} {b} {a.upper()} end".encode())
        assert words[0] != words[1] and words[0] == words[2]
        assert vector.words_of(f"x {b}".encode())[1] == words[1]
