import random
import re
from collections import Counter, defaultdict

import pytest

from tidebook.llm import mix as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(t):
    return len(WORD.findall(t or ""))


def brute_targets(sizes, most=3):
    """Share by weight; what exceeds a source's most goes to the others, until none does."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in rest) for s in order}
        over = {s for s in rest if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mix(request, which):
    check_mix(request.getfixturevalue(which))


def check_mix(df):
    rows = df.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    want, got = brute_targets(sizes), M.mix(df).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, size(r.text)) for r in rows)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size and len(r.shards) == r.copies
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(longest[s] / 2, 1) + 1


def test_rerun(docs):
    a, b = (sorted(map(str, M.mix(d).drop("row").collect())) for d in (docs, docs.repartition(5)))
    assert a == b


def test_tree_splits_exactly(spark):
    slots = spark.createDataFrame([(s, b) for s in range(3) for b in range(50)], "sid int, slot bigint")
    leaves, of = Counter(), Counter()
    for r in M.split(slots, 3).collect():
        leaves[r.shard] += r.quota
        of[r.sid] += r.quota
    assert of == {0: 50, 1: 50, 2: 50} and len(leaves) == 8 and max(leaves.values()) - min(leaves.values()) <= 1


def test_quotas_of_the_left_child_are_hypergeometric(spark, monkeypatch):
    """Over many seeds: the mean and the variance of the count that goes left are those of the law."""
    slots, left = spark.createDataFrame([(s, b) for s, n in ((0, 12), (1, 28)) for b in range(n)], "sid int, slot bigint").coalesce(1), []
    for seed in range(12):
        monkeypatch.setattr(M, "SEED", seed * 1000)
        left.append(sum(r.quota for r in M.split(slots, 1).collect() if r.sid == 0 and r.shard == 0))
    mean = sum(left) / 12
    variance = sum((x - mean) ** 2 for x in left) / 11
    assert abs(mean - 6) < 1.4 and 0.4 < variance < 6  # 20 of 40 with 12 marked: 6 and 2.15


def test_what_is_taken_follows_the_quotas(docs, monkeypatch):
    """A source whose quotas are taken away gives nothing, and its documents have no shard."""
    split = M.split
    monkeypatch.setattr(M, "split", lambda slots, levels: split(slots, levels).filter("sid != 1"))
    rows, sources = M.mix(docs).collect(), sorted({r.source for r in docs.collect() if r.source is not None})
    assert all((r.taken == 0 and not r.shards) for r in rows if r.source == sources[0])
    assert any(r.taken for r in rows if r.source != sources[0])


@pytest.mark.parametrize("bounds", [{"RANGE": 2, "BLOCK_DOCS": 4}, {"BROADCAST_PLAN": 0, "BROADCAST_SOURCES": 0}])
def test_bounds(odd, monkeypatch, bounds):
    plain = sorted(map(str, M.mix(odd).drop("row").collect())) if "RANGE" not in bounds else None
    for name, value in bounds.items():
        monkeypatch.setattr(M, name, value)
    assert ("RANGE" in bounds) or sorted(map(str, M.mix(odd).drop("row").collect())) == plain
    check_mix(odd)


def test_repeated_rows(spark):
    """Rows that are one row a thousand times are dealt into blocks and drawn one by one."""
    rows = [(1, "a b c", "x")] * 1000 + [(i, "d e f g", "y") for i in range(300)] + [(None, "h i", None)] * 200
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    check_mix(df)
    a, b = (sorted(map(str, M.mix(d).drop("row", "shards").collect())) for d in (df, df.repartition(2)))
    assert a == b
    taken = sum(r.taken for r in M.mix(df).collect())
    assert sum(size(r.text) for r in M.mixed_documents(df).collect()) == taken


def test_stage(odd, docs, none):
    for df in (odd, docs):
        copies = Counter()
        for r in M.mix(df, 2).collect():
            copies[r.doc_id, r.size, r.source] += r.copies
        out = M.mixed_documents(df, 2)
        assert out.columns == df.columns
        assert Counter((r.doc_id, size(r.text), r.source) for r in out.collect()) == +copies
        whole = {tuple(r) for r in df.collect()}
        assert all(tuple(r) in whole for r in out.collect())
    assert M.mixed_documents(none).count() == 0 and M.mix(none).count() == 0


def test_long_documents_do_not_stop_the_filling(spark):
    """However long a document at the cut is, the others fill the target until none improves it."""
    rng = random.Random(3)
    sources = {f"s{i}": [100] * 600 + [60_000] for i in range(8)} | {f"t{i}": [rng.randint(1, 900) for _ in range(700)] + [90_000, 200_000] for i in range(4)} | {"u": [7, 7, 7], "v": [5000, 40]}
    share = {"s": 0.35, "t": 0.5, "u": 1.5, "v": 0.9}
    rows = [(n, n, s, size, rng.getrandbits(62), n, 0) for n, (s, size) in enumerate((s, x) for s, sizes in sources.items() for x in sizes)]
    sizes = spark.createDataFrame(rows, "row bigint, doc_id bigint, source string, size bigint, key bigint, same bigint, number bigint")
    of = [(i, s, sum(x), len(x), 1, float(round(sum(x) * share[s[0]]))) for i, (s, x) in enumerate(sources.items())]
    draws = M.drawn(sizes, spark.createDataFrame(of, "sid int, source string, source_size bigint, n_docs bigint, weight int, target double")).collect()
    assert len(draws) == len(rows)
    for sid, s, size, _, _, target in of:
        mine = [r for r in draws if r.sid == sid]
        gap = target - sum(r.copies * r.size for r in mine)
        whole = int(target // size)
        assert s[0] in "uv" or abs(gap) <= 50, (s, gap)
        # no document that may still come, or go, would bring the source nearer
        assert all(abs(gap - r.size) >= abs(gap) for r in mine if r.copies == whole), (s, gap)
        assert all(abs(gap + r.size) >= abs(gap) for r in mine if r.copies > whole), (s, gap)
