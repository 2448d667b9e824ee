import json
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidebook.llm import entries
from tidebook.llm import tokenstore as S


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(entries.tokenizer_path())


def brute(rows, tokenizer):
    out = Counter()
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    return out


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_round_trip(spark, request, tokenizer, which):
    df = request.getfixturevalue(which)
    path = S.write(df, entries.tokenizer_path(), S.new_path(spark))
    rows = S.digest_of(spark, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == brute([(r.doc_id, r.text) for r in df.collect()], tokenizer)
    ordered, at = sorted(rows, key=lambda r: r.start), 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    whole = {(r.doc_id, tuple(r.ids)) for r in S.documents(spark, path).collect()}
    assert whole == {(r.doc_id, (*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2)) for r in df.collect()}
    assert S.verified(spark, path)


def test_damage_is_found(spark, docs):
    path = S.write(docs, entries.tokenizer_path(), S.new_path(spark))
    good = {part: spark.read.parquet(f"{path}/{part}") for part in ("chunks", "recipes", "manifest")}
    assert good["chunks"].select("digest").distinct().count() == good["chunks"].count()

    def with_(**changed):
        broken = S.new_path(spark)
        for part, df in (good | changed).items():
            df.write.parquet(f"{broken}/{part}")
        return broken

    lost = with_(chunks=good["chunks"].limit(10))
    assert not S.verified(spark, lost)
    with pytest.raises(Exception, match="lacks chunks"):
        S.digest_of(spark, lost).collect()
    with pytest.raises(Exception, match="damaged"):
        S.digest_of(spark, with_(chunks=good["chunks"].selectExpr("digest", "concat(ids, x'0000') as ids"))).collect()
    for changed in ("n_tokens + 1 as n_tokens, digests", "n_tokens, slice(digests, 1, 1) as digests"):
        with pytest.raises(Exception, match="manifest"):
            S.digest_of(spark, with_(recipes=good["recipes"].selectExpr("part", "seq", "doc_id", "start", "leaf", *changed.split(", ", 1)))).collect()


def test_bounds_change_nothing(spark, odd, tokenizer, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    rows = S.encoded(odd, entries.tokenizer_path()).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == brute([(r.doc_id, r.text) for r in odd.collect()], tokenizer)


ODD = ["", " ", "a  b", "a \n b\n\n", "it's don't 'll x's", "tab\there", "non\xa0breaking", "a\r\nb", "<|endoftext|> x", "１２３ 漢字 🙂🙂", "x" * 3000, "  lead", "trail  ", "\n\n\n", "3.14 - (a)  [b]", "a\u200bb", "A B  C   D", "\n x", " \n  x \n", "x\n \ny", "“q” — e…", "\x1c", "<", "|", "a\u3000b"]


def same_ids(e, texts, tokenizer):
    assert [x.tolist() for x in e.encode([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("kept, slots", [(0, 8), (3, 8), (400_000, 4), (2_000_000, 1 << 22)])
def test_pieces_give_the_ids_of_whole_texts(tokenizer, monkeypatch, kept, slots):
    monkeypatch.setattr(S, "KEPT_PIECES", kept)
    monkeypatch.setattr(S, "SLOTS", slots)
    e = S.Encoder(entries.tokenizer_path())
    for at in range(0, len(ODD), 4):
        same_ids(e, ODD[at : at + 4], tokenizer)
    same_ids(e, ODD, tokenizer)


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n  ab'.1<|\t\u00a0\u2003é漢"), st.characters(codec="utf-8")), max_size=30), max_size=6))
@settings(max_examples=300, deadline=None)
def test_random_texts(texts):
    same_ids(S.encoder(entries.tokenizer_path()), texts, S.encoder(entries.tokenizer_path()).tokenizer)


def test_long_texts_go_in_parts(tokenizer, monkeypatch):
    monkeypatch.setattr(S, "SPAN", 50)
    same_ids(S.Encoder(entries.tokenizer_path()), ["ab cd\n\n e" * 40, "x" * 200 + " y", " " * 120 + "z", "a b"], tokenizer)


def test_another_pre_tokenizer_goes_whole(tmp_path, tokenizer):
    spec = json.loads(tokenizer.to_str())
    spec["pre_tokenizer"]["use_regex"] = False
    (tmp_path / "other.json").write_text(json.dumps(spec))
    e = S.Encoder(str(tmp_path / "other.json"))
    assert not e.piecewise and S.Encoder(entries.tokenizer_path()).piecewise
    same_ids(e, ODD, Tokenizer.from_file(str(tmp_path / "other.json")))


def test_chunks_depend_on_content_alone():
    ids = np.random.default_rng(0).integers(0, 50_000, 20_000).astype("<u2")
    a, b = (S.cuts(x) for x in (ids, np.concatenate([ids[:7], ids])))
    shared = {z for z in a} & {z - 7 for z in b}
    assert len(shared) > 0.9 * len(a) and a[-1] == 20_000 and max(np.diff([0, *a])) <= S.LONGEST


def thue_morse(n):
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_share_a_polynomial_hash(tokenizer, n):
    a, b = thue_morse(n)
    encoder = S.Encoder(entries.tokenizer_path())
    for text in (a, b, f"{a} {b}\n{b} {a}"):
        assert encoder.encode([text.encode()])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_equal_hashes_are_told_apart_by_bytes(tokenizer, monkeypatch):
    """All pieces share a few hashes."""
    monkeypatch.setattr(S, "mix", lambda x: x % np.uint64(3))
    encoder = S.Encoder(entries.tokenizer_path())
    texts = ["one two three four five", "two one  six\n\nseven one", "x" * 300 + " one " + "x" * 300, "eight bytes morethan eight bytes more", "one"]
    for _ in range(2):
        got = encoder.encode([x.encode() for x in texts])
        assert [x.tolist() for x in got] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_runs_of_newlines(tokenizer):
    """Runs of white space before words, at ends of texts and beside other texts of a batch."""
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(["a", "word", "7", "don't", "é", "...", " ", "\n", "\n\n", "  "], rng.integers(0, 12))) for _ in range(3000)]
    got = S.Encoder(entries.tokenizer_path()).encode([x.encode() for x in texts])
    wrong = [x for x, ids in zip(texts, got, strict=True) if ids.tolist() != tokenizer.encode(x, add_special_tokens=False).ids]
    assert not wrong, wrong[:5]
