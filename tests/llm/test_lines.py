import hashlib
import random
from collections import defaultdict

import pytest

from tidebook.llm import lines as L

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=L.MIN_CHARS, min_docs=L.MIN_DOCS):
    key = lambda x: x.strip(WHITE).translate(LOWER)
    holders = defaultdict(set)
    for i, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    rank = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    last = {k: max(map(rank, v)) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, (doc, text) in enumerate(rows):
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if not rank(i) < last.get(key(x), (False, 0))]
        out.append((doc, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()), key=str)


def made(seed, n=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeÄß🙂 ") for _ in range(rng.randint(2, 14))) for _ in range(12)]
    text = lambda: "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str])(rng.choice(pool)) + rng.choice(["", "\r", " "]) for _ in range(rng.randint(0, 9)))
    return [(rng.choice([None, *range(40)]), rng.choice([None, "", text(), text(), text()])) for _ in range(n)]


@pytest.mark.parametrize("seed, batches", [(1, 1), (2, 3), (3, 7)])
def test_against_brute_force(spark, seed, batches):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert got(L.deduplicated(df, 5, 3, batches)) == brute(rows, 5, 3)


def test_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(L.deduplicated(docs)) == brute(rows)
    assert sum(x[2] for x in brute(rows)) > 0


def test_odd_rows(spark, odd, none):
    assert got(L.deduplicated(odd, 3, 2)) == brute([(r.doc_id, r.text) for r in odd.collect()], 3, 2)
    assert L.deduplicated(none).count() == 0
    nulls = spark.createDataFrame([(None, "x" * 50)] * 6, "doc_id bigint, text string")
    assert {r.n_dropped for r in L.deduplicated(nulls).collect()} == {0}


def test_store_over_sessions(spark, tmp_path):
    """Batches given one at a time, to a store that is opened anew each time, see what all batches before had."""
    line, path = "the same line of more than forty code points, again", f"file://{tmp_path}/store"
    docs = lambda ids: spark.createDataFrame([(i, f"{line}\nown {i}") for i in ids], "doc_id bigint, text string")
    dropped = lambda ids: sorted(r.doc_id for r in L.deduplicated(docs(ids), batches=1, store=L.LineRuns(spark, path)).filter("n_dropped > 0").collect())
    assert dropped(range(3)) == []
    assert dropped([10, 11]) == [10]  # five documents now, and 11 keeps the line
    assert dropped([5, 6]) == [5, 6]
    assert dropped([20, 21]) == [20]
    store = L.LineRuns(spark, path)
    assert len(store.runs) == 2 and sorted(level for level, _ in store.runs) == [0, 1]
    assert [(r.n_docs, r.last_doc) for r in store.frequent().collect()] == [(9, 21)]


def test_settled_lines_stay_out_of_later_runs(spark, tmp_path):
    entries = lambda ids: L.line_entries(spark.createDataFrame([(i, "a line that is long enough to be counted as one") for i in ids], "doc_id bigint, text string"))
    store = L.LineRuns(spark, f"file://{tmp_path}/runs", fanout=99)
    for ids in (range(90, 100), range(50, 60), range(200, 201)):
        store.add(entries(ids))
    assert [store.read([run]).count() for run in store.runs] == [1, 0, 1]
    assert store.frequent().first().last_doc == 200
