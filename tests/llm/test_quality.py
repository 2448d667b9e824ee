import re
from collections import Counter

from tidebook.llm import quality as Q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            hit |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_odd_rows(odd, none):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted(((r.doc_id, *(r[c] for c in names)) for r in Q.judged(odd).collect()), key=str)
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in odd.collect()), key=str)
    assert Q.judged(none).count() == 0


def test_table_decides(odd):
    rows = Q.judged(odd, [("never", "mean_word_chars", 1e9, None)]).collect()
    assert not any(r.kept or r.pass_never for r in rows)
    assert any(r.kept for r in Q.judged(odd, []).collect())


def test_clean_documents_stay(docs):
    """Prose without markup or repetition is kept; what goes has a symbol for every fourth word, or no function words."""
    rows = Q.judged(docs).filter("not base_failed").collect()
    assert all(r.kept == (r.symbols_per_word <= 0.25 and r.pass_stop_words) for r in rows)
    assert 0 < sum(not r.kept for r in rows) < 0.1 * len(rows)


def test_each_rule_can_fail(spark):
    word = lambda i: "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(5 + i % 3))
    prose = "the " + " ".join(f"{word(i)} {word(3 * i + 1)} and" for i in range(30))
    lines = [f"the {word(i)} {word(i + 40)} of {word(i + 90)}" for i in range(12)]
    texts = {
        "": prose, "words": "one two", "length": " ".join(f"the {'x' * (90 + i)}" for i in range(30)), "symbols": prose.replace("and", "&"), "digits": " ".join(f"the {10**9 + i * 7919}" for i in range(40)),
        "stop_words": " ".join(word(i) + str(i) for i in range(80)), "lines": "\n".join(x for x in ["a the"] * 30 + lines), "bullets": "\n".join(f"- {x}" for x in lines), "ellipses": "\n".join(f"{x}..." for x in lines),
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    for r in Q.judged(df).collect():
        failed = {name for name, _, _, _ in Q.THRESHOLDS if not r[f"pass_{name}"]}
        assert r.doc_id in failed or (not r.doc_id and not failed), (r.doc_id, failed)
