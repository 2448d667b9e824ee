import hashlib
import re

import pytest

from tidebook.llm import pii as P


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(t):
    t, out = t or "", []
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    for rank, (kind, pattern, ok) in enumerate(kinds):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, t) if ok(m[0])]
    spans = sorted(out)
    text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
    return [sum(k == x for _, _, k, _ in spans) for x in P.KINDS], hashlib.sha256(text.encode()).hexdigest(), text


TEXTS = [
    "mail a.b+c@x-y.example.org, or <q@w.de>. x@y @z.de a@b.c.d.", "1.2.3.4 and 256.1.1.1 and 10.0.0.255.7 01.002.0003.4 1.2.3", "4111 1111 1111 1111 or 4111-1111-1111-1112; 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 0000000000000", "+1 (555) 123-4567 and +49.30.1234567890123456 and +12-3 +1+2345678901",
    "é€🙂 a@b.co 🙂 1.2.3.4 ü +44 20 7946 0958", "a@b.c@d.e@f.g", "1.2.3.4.5.6.7.8", "99999999999999999999.1.1.1", "....@...", "a" * 5000 + "@" + "b.c", "1 " * 3000, "1." * 3000, "+1" + " 2" * 3000, "@" * 2000, "x@" * 2000,
    "password = 'Zx9Kd82mQpL0aWe4RtYu7Bn' and token: ghp_16C7e42F292c6912E7710c838347Ae178B4a", "just_a_long_identifier_name_here twice", "ssn 123-45-6789 here",
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    return {r.doc_id: r for r in P.found(df).collect()}


def test_base_spans(found):
    for i, t in enumerate(TEXTS):
        counts, digest, text = brute(t)
        r = found[i]
        assert [r[f"n_{k}"] for k in P.KINDS] == counts, t[:60]
        assert r.base_sha256 == digest, t[:60]
        base = [s for s in r.spans.split(",") if s.split(":")[0] in P.KINDS]
        assert ",".join(base) == text
    assert any("secret" in r.spans for r in found.values()) and "national_id" in found[17].spans and "secret" not in found[16].spans


def test_documents_and_odd_rows(docs, odd, none):
    for df in (docs, odd):
        got = sorted(((r.doc_id, [r[f"n_{k}"] for k in P.KINDS], r.base_sha256) for r in P.found(df).collect()), key=str)
        assert got == sorted(((r.doc_id, *brute(r.text)[:2]) for r in df.collect()), key=str)
    assert P.found(none).count() == 0


def test_masking(spark):
    df = spark.createDataFrame([(1, "write to a@b.de or 1.2.3.4 now"), (2, None), (3, "clean")], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in P.masked(df).collect()} == {1: "write to <email> or <ip> now", 2: None, 3: "clean"}


def test_bare_numbers_do_not_outvote_introduced_ones(spark):
    """What is introduced stays, however many numbers of its shape are not."""
    number = lambda i: f"{100 + i % 800}-{10 + i % 90}-{1000 + i}"
    rows = [(i, f"my ssn: {number(i)} ok") for i in range(100)] + [(1000 + i, f"part {number(i)} of the list") for i in range(300)]
    got = {r.doc_id: r.spans for r in P.found(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i].startswith("national_id:8:") for i in range(100))
    assert not any(got[1000 + i] for i in range(300))


def test_long_secrets_are_judged_whole(spark):
    """Digits behind the first 256 characters count."""
    rows = [(1, "token: " + "aB" * 200 + "1234567890"), (2, "token: " + "aB" * 20 + "123"), (3, "word " * 9)]
    c = {r.row: r for r in P.candidates(P.scanned(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1))).collect()}
    assert [(r.shape, r.f_digits) for _, r in sorted(c.items())] == [(1, 0), (1, 0)]
    assert all(not r.f_hex and not r.f_wordlike and r.end - r.start in (410, 43) for r in c.values())


def test_planted_data(spark):
    """Of tokens that are introduced and of numbers as long as a card's, at least 0.9 have a span; texts without digits none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in P.found(docs).collect()}
    planted, hit = 0, 0
    for r in docs.collect():
        spans = [tuple(map(int, s.split(":")[1:])) for s in got[r.doc_id].spans.split(",") if s]
        for m in re.finditer(r'(?<=token = ")[0-9a-f]{40}|(?<![0-9])[0-9]{16}(?![0-9])', r.text or ""):
            planted += 1
            hit += any(a <= m.start() and m.end() <= z for a, z in spans)
        assert spans == [] or re.search("[0-9]", r.text)
        assert len(spans) == got[r.doc_id].n_spans
    assert planted > 20 and hit >= 0.9 * planted


def test_kinds(spark):
    """What is introduced, or holds by itself, is found; what says that it is something else isn't."""
    rows = [(kind, f"{i} {text}") for i in range(12) for kind, text in [
        ("iban", "IBAN DE89 3704 0044 0532 0130 00 please"), ("iban", "Konto: GB82WEST12345698765432."), ("mac", "device mac: 00:1B:44:11:3A:B7 up"), ("birth_date", "geboren 12.03.1980 in Rom"),
        ("account", "card 4000123412341235 expired"), ("national_id", "my ssn: 123-45-6789."), ("secret", "api_key=a8Kd93jfLs02mZx81QpW55tY"),
        ("no", "IBAN DE88 3704 0044 0532 0130 00 please"), ("no", "sha256 a8bd93cf0e02f1a8810755ff23a8bd93cf"), ("no", "released 12.03.1980 in Rom"), ("no", "geboren 45.03.1980 in Rom"), ("no", "ssn: 000-45-6789."),
        ("no", "isbn 9780306406157000 here"), ("no", "see /usr/share/some_long_directory_name/file"),
    ]]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "doc_id bigint, want string, text string")
    got = {r.doc_id: {s.split(":")[0] for s in r.spans.split(",") if s} for r in P.found(df).collect()}
    wrong = [(k, t, got[i]) for i, (k, t) in enumerate(rows) if got[i] != ({k} if k != "no" else set())]
    assert not wrong, wrong[:14]


def test_many_matches_and_labelers_that_abstain(spark):
    rows = [(1, "1.2.3.4 " * 20_000), (2, "a@b.c " * 5_000 + "x")]
    got = {r.doc_id: r for r in P.found(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        counts, digest, _ = brute(t)
        assert [got[i][f"n_{k}"] for k in P.KINDS] == counts and got[i].base_sha256 == digest
    c = P.candidates(P.scanned(spark.createDataFrame([(1, "bare 1234567890123 here")], "doc_id bigint, text string"))).collect()
    assert [(r.kind, r.shape, r.gazetteer, r.context) for r in c] == [("account", -1, -1, -1)]


def test_each_labeler_counts(spark, monkeypatch):
    """Spans change if the expectation-maximisation's posteriors do: they decide, not the patterns alone."""
    df = spark.createDataFrame([(i, f"token: a8Kd93jfLs02mZx81QpW55t{i}") for i in range(20)], "doc_id bigint, text string")
    assert all(r.n_added == 1 for r in P.found(df).collect())
    real = P.posteriors
    monkeypatch.setattr(P, "posteriors", lambda votes: real(votes).withColumn("p", 1 - P.F.col("p")))
    assert all(r.n_added == 0 for r in P.found(df).collect())
