"""Personal data by weak supervision (DataFrame functions only).

Base patterns (e-mail, IP, card, phone) always stay. More spans come from candidates that weak labelers
vote on, each of which may also abstain: a regular expression on the candidate's shape, a gazetteer of words that
introduce such data or something else, and a context labeler on what stands before it. Votes of equal pattern are
counted, so expectation-maximisation over the latent class (personal data or not) runs on a table of at most
``3 ** labelers`` rows per kind, whatever the corpus holds. The posteriors of the patterns are soft labels, from
which one more aggregation trains the span classifier: a naive Bayes model over features of the candidate's text
alone. A candidate is a span if the votes for it outweigh those against, its posterior agrees, and still does when the classifier's
evidence is added: the votes' log-odds, which hold the prior, plus the weights of the features, which don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import stored

#: (kind, cheap test, pattern). The look-behinds only spare the engine a start inside a run of characters
#: it has already failed on; ``\G`` lets a match begin where the last one ended. Runs are possessive, so
#: matching is linear on any text.
BASE = [
    ("email", lambda t: F.contains(t, F.lit("@")), r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", lambda t: t.rlike(r"\+[0-9]"), r"\+[0-9][\x20().0-9-]+[0-9]"),
]
KINDS = [kind for kind, _, _ in BASE]

#: Candidates of further kinds: (kind, cheap test, pattern). Where two overlap, the first kind has it. Secrets are long
#: runs of letters and digits; accounts are numbers as long as those of cards.
CANDIDATES = [
    ("national_id", lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), r"(?:\G|(?<![0-9-]))[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{11}"), r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("account", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), r"(?<![0-9]|[0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"),
    ("mac", lambda t: t.rlike(r"(?:[0-9A-Fa-f]{2}[:-]){5}"), r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:-])"),
    ("birth_date", lambda t: t.rlike(r"[0-9][./-](?:19|20)[0-9]{2}"), r"(?<![0-9./-])[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}(?![0-9/-])"),
    ("secret", lambda t: t.rlike(r"[A-Za-z0-9_+/=-]{20}"), r"(?:\G|(?<![A-Za-z0-9_+/=-]))[A-Za-z0-9_+/=-]{20,}+"),
]
#: Words that introduce what they name, in English, German, French and Spanish.
GAZETTEER = {
    "national_id": "ssn social security id tax insurance passport ausweis steuer securite social numero dni nif",
    "iban": "iban account konto bank compte cuenta transfer",
    "account": "card credit debit visa mastercard amex account acct konto karte carte compte tarjeta cuenta number no nr",
    "mac": "mac hwaddr ether ethernet wifi device bssid hardware",
    "birth_date": "born birth birthday dob geboren geburtsdatum ne nee naissance nacido nacida nacimiento",
    "secret": "token secret key apikey api_key password passwd pwd bearer authorization credential credentials auth",
}
#: Words that introduce what looks alike and isn't personal.
OTHERS = {
    "national_id": "part item order version sku model", "iban": "part serial model", "account": "isbn ean timestamp order invoice tracking id",
    "mac": "part serial", "birth_date": "published updated released version date since until on", "secret": "sha sha1 sha256 md5 checksum commit hash digest uuid etag integrity",
}
CONTEXT = 24
#: Matches whose positions are summed up at once.
RUN = 64
ROUNDS = 20
#: Posteriors are taken as at least this far from 0 and 1.
SURE = 1e-9


def bound(column: Column, f) -> Column:
    """f of a column that is computed once: a let-binding by an array of one element."""
    return F.element_at(F.transform(F.array(column), f), 1)


def find(text: Column, kind: str, test, pattern: str) -> Column:
    """An array of ``(kind, start, end, value)`` of the leftmost non-overlapping matches; code points, end exclusive.

    The pieces that `split` leaves between the matches give the positions, so a text is scanned twice
    however many matches it has. Positions are summed up in runs of `RUN` matches, each from the sums of the
    runs before, so that no long array is copied match by match.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def located(pairs: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int"))
        run = lambda k: F.slice(pairs, k * RUN + 1, F.lit(RUN))
        sums = F.transform(runs, lambda k: F.aggregate(run(k), F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["value"])))
        before = lambda s, k: F.aggregate(F.slice(s, F.lit(1), k), F.lit(0), lambda n, x: n + x)
        spans = lambda s: F.flatten(F.transform(runs, lambda k: F.aggregate(run(k), F.struct(before(s, k).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])))
        return F.when(F.size(pairs) == 0, empty).otherwise(bound(sums, spans))

    both = bound(values, lambda v: F.zip_with(F.slice(gaps, F.lit(1), F.size(v)), v, lambda g, x: F.struct(g.alias("gap"), x.alias("value"))))
    return F.when(test(text), bound(both, located)).otherwise(empty)


def luhn(digits: Column) -> Column:
    """Whether the digits pass the check: from the right, every second one doubled, with 9 taken off above 9."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda n, x: n + x) % 10 == 0


def iban_holds(value: Column) -> Column:
    """Whether the number, its first four characters last and letters as 10 to 35, is 1 modulo 97."""
    plain = F.regexp_replace(value, "[^A-Z0-9]", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda n, c: (n * F.when(c.rlike("[0-9]"), 10).otherwise(100) + code(c)) % 97) == 1


def valid(x: Column, kind: str) -> Column:
    digits = F.regexp_replace(x["value"], "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(x["value"], r"\."), lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The valid base matches of a text, by start, then kind in the order of `KINDS`."""
    rank = F.create_map(*[F.lit(x) for pair in ((k, i) for i, k in enumerate(KINDS)) for x in pair])

    def kept(kind: str, test, pattern: str) -> Column:
        return F.filter(find(text, kind, test, pattern), lambda x: valid(x, kind))

    found = F.concat(*[kept(*b) for b in BASE])
    keyed = F.transform(found, lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def candidates(spans: DataFrame) -> DataFrame:
    """One row per candidate: ``row, kind, start, end``, its labelers' votes and its features.

    Votes are 1 (personal), 0 (not) or -1 (no opinion). What a kind's own rules refute (a wrong check digit, a month
    beyond 31, one digit repeated) is no candidate.
    """
    rank = F.create_map(*[F.lit(x) for i, (kind, _, _) in enumerate(CANDIDATES) for x in (kind, i)])
    c = spans.select("row", F.explode("candidates").alias("c"), "base", "candidates").select("row", "c.*", "base", "candidates")
    touches = lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"])
    taken = F.exists("base", touches) | F.exists("candidates", lambda b: touches(b) & (rank[b["kind"]] < rank[F.col("kind")]))
    c = c.filter(~taken & ~F.col("odd"))
    n, digits, letters = F.col("end") - F.col("start"), F.col("digits"), F.col("letters")
    of = lambda kind: F.col("kind") == kind
    shape = F.when(of("secret"), F.when((digits >= 3) & (letters >= 3), 1).when(F.col("wordlike"), 0).otherwise(-1))
    shape = shape.when(of("account") & ((digits == 16) | (digits == 15) & (F.col("first") == "3")), 1).when(of("iban"), 1).otherwise(-1)
    words = lambda table: F.create_map(*[F.lit(x) if i == 0 else F.array(*[F.lit(w) for w in x.split()]) for pair in table.items() for i, x in enumerate(pair)])[F.col("kind")]
    lead = F.regexp_extract_all(F.lower("before"), F.lit(r"[\p{Ll}_]+[0-9]*"), F.lit(0))
    gazetteer = F.when(F.arrays_overlap(lead, words(OTHERS)), 0).when(F.arrays_overlap(lead, words(GAZETTEER)), 1).otherwise(-1)
    context = F.when(F.col("before").rlike(r"[=:]\s*[\"'`]?$"), 1).when(F.col("before").rlike(r"[/\\\\#@._~-]$"), 0).otherwise(-1)
    return c.select(
        "row", "kind", "start", "end", shape.alias("shape"), gazetteer.alias("gazetteer"), context.alias("context"),
        F.least(F.floor(n / 8), F.lit(8)).alias("f_length"), F.floor(4 * digits / n).alias("f_digits"), F.col("hex").alias("f_hex"), F.col("wordlike").alias("f_wordlike"),
    )


LABELERS = ["shape", "gazetteer", "context"]
#: What a vote counts in the first round and the last word; a word that names the thing says more than its looks.
WEIGHT = {"shape": 1, "gazetteer": 2, "context": 1}
PATTERNS = f"array<struct<{','.join(f'{x}:int' for x in LABELERS)},n:double,p:double>>"


def maximised(patterns: Column) -> Column:
    """`ROUNDS` rounds of expectation-maximisation over an array of vote patterns ``(votes, n, p)``; p is renewed.

    A round sums up how often each labeler says yes, and has an opinion at all, in either class, and from these
    rates and the prior computes every pattern's odds again.
    """
    def sums(rows: Column) -> Column:
        fields = {"n1": lambda x: x["n"] * x["p"], "n0": lambda x: x["n"] * (1 - x["p"])}
        weight = {1: fields["n1"], 0: fields["n0"]}
        for name in LABELERS:
            for c in (1, 0):
                fields[f"{name}_{c}"] = lambda x, name=name, c=c: F.when(x[name] == c, weight[c](x)).otherwise(0.0)
                fields[f"{name}_of{c}"] = lambda x, name=name, c=c: F.when(x[name] >= 0, weight[c](x)).otherwise(0.0)
        return F.aggregate(rows, F.struct(*[F.lit(0.0).alias(f) for f in fields]), lambda acc, x: F.struct(*[(acc[f] + g(x)).alias(f) for f, g in fields.items()]))

    def renewed(rows: Column, s: Column) -> Column:
        prior = (s["n1"] + 1) / (s["n1"] + s["n0"] + 2)
        rate = {(x, c): (s[f"{x}_{c}"] + 1) / (s[f"{x}_of{c}"] + 1.2) for x in LABELERS for c in (1, 0)}

        def one(x: Column) -> Column:
            odds = F.log(prior / (1 - prior))
            for name in LABELERS:
                yes, no = F.log(rate[name, 1] / (1 - rate[name, 0])), F.log((1 - rate[name, 1]) / rate[name, 0])
                odds = odds + F.when(x[name] == 1, yes).when(x[name] == 0, no).otherwise(0.0)
            return F.struct(*[x[name].alias(name) for name in LABELERS], x["n"].alias("n"), (1 / (1 + F.exp(-odds))).alias("p"))

        return F.transform(rows, one)

    def step(rows: Column, _: Column) -> Column:
        return F.element_at(F.transform(F.array(sums(rows)), lambda s: renewed(rows, s)), 1).cast(PATTERNS)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), patterns.cast(PATTERNS), step)


def posteriors(votes: DataFrame) -> DataFrame:
    """``kind, shape, gazetteer, context, p``, stored: expectation-maximisation over vote patterns.

    Labelers are independent given the class, each with a reliability of its own for either class. Counting
    leaves at most 27 patterns a kind, which fit into one array, so all rounds are one expression. A prior of
    one right and a fifth of a wrong vote keeps the classes from trading places.
    """
    opinions = sum(F.when(F.col(x) >= 0, WEIGHT[x] * F.col(x)).otherwise(0) for x in LABELERS)
    asked = F.greatest(F.lit(1), sum(F.when(F.col(x) >= 0, WEIGHT[x]).otherwise(0) for x in LABELERS))
    counted = votes.groupBy("kind", *LABELERS).agg(F.count("*").cast("double").alias("n")).withColumn("p", 0.05 + 0.9 * opinions / asked)
    patterns = counted.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(*LABELERS, "n", "p"))).alias("rows"))
    found = patterns.select("kind", F.explode(maximised(F.col("rows"))).alias("x")).select("kind", *[F.col(f"x.{x}").alias(x) for x in LABELERS], "x.p")
    return stored(found.coalesce(1), "pii-posteriors")


def classified(cands: DataFrame) -> DataFrame:
    """The candidates that are spans: ``row, kind, start, end``."""
    features = ["f_length", "f_digits", "f_hex", "f_wordlike"]
    p = posteriors(cands)
    soft = cands.join(F.broadcast(p), ["kind", *LABELERS])  # at most 27 rows a kind
    long = soft.select("kind", "p", F.explode(F.array(*[F.concat_ws("=", F.lit(f), F.col(f).cast("string")) for f in features])).alias("feature"))
    counts = long.groupBy("kind", "feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    totals = soft.groupBy("kind").agg(F.sum("p").alias("all_yes"), F.sum(1 - F.col("p")).alias("all_no"))
    model = counts.join(totals, "kind").select("kind", "feature", F.log(((F.col("yes") + 1) / (F.col("all_yes") + 2)) / ((F.col("no") + 1) / (F.col("all_no") + 2))).alias("w"))
    # at most 9 + 5 + 2 + 2 feature values a kind
    model = F.broadcast(stored(model.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("feature", "w"))).alias("w")).coalesce(1), "pii-model"))
    sure = F.least(F.greatest("p", F.lit(SURE)), F.lit(1 - SURE))
    score = F.log(sure / (1 - sure)) + sum(F.coalesce(F.col("w")[F.concat_ws("=", F.lit(f), F.col(f).cast("string"))], F.lit(0.0)) for f in features)
    yes = sum(F.when(F.col(x) == 1, w).when(F.col(x) == 0, -w).otherwise(0) for x, w in WEIGHT.items()) > 0
    return soft.join(model, "kind").filter(yes & (F.col("p") > 0.5) & (score > 0)).select("row", "kind", "start", "end")


def scanned(docs: DataFrame) -> DataFrame:
    """Stored: ``row, doc_id, base, candidates`` of every row."""
    text = F.coalesce("text", F.lit(""))
    more = F.concat(*[find(text, *c) for c in CANDIDATES])
    before = lambda x: F.substring(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT)))
    others = lambda v, chars: F.length(F.regexp_replace(v, chars, ""))
    # values are counted whole here, so that none has to be stored
    alike = lambda v: F.length(F.regexp_replace(v, r"[^0-9]|([0-9])(?=[^0-9]*\1)", "")) < 3
    strange = lambda k, v: F.when(k == "account", alike(v)).when(k == "iban", ~iban_holds(v)).when(k == "national_id", v.rlike("^(?:000|666|9)|-00-|-0000$")).when(k == "birth_date", ~v.rlike(r"^(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|[12][0-9]|3[01])[./-]")).otherwise(F.lit(False))
    counts = lambda v: [(F.length(v) - others(v, "[0-9]")).alias("digits"), (F.length(v) - others(v, "[A-Za-z]")).alias("letters"), (others(v, "[0-9a-f]") == 0).alias("hex"), v.rlike("[a-z]{6}").alias("wordlike")]
    shown = F.transform(more, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), *counts(x["value"]), F.substring(x["value"], 1, 1).alias("first"), strange(x["kind"], x["value"]).alias("odd"), before(x).alias("before")))
    return stored(docs.select("doc_id", base_spans(text).alias("base"), shown.alias("candidates")).withColumn("row", F.monotonically_increasing_id()), "pii-spans")


def found(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans, row``.

    A null text is empty and has no spans. Texts are judged alone, but the model of the added kinds is
    fitted on all rows, repeated ones included. Ties in start are ordered by kind. Further columns are
    ignored; an empty table gives no rows.
    """
    spans = scanned(docs)
    added = classified(stored(candidates(spans), "pii-candidates")).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", "kind")).alias("added"))
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.join(added, "row", "left").select(
        "doc_id", *[n(k) for k in KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"), (F.size("base") + F.coalesce(F.size("added"), F.lit(0))).cast("long").alias("n_spans"), "row",
    )


def masked(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind in angle brackets, from the last to the first."""
    numbered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    spans = found(docs).select("row", F.filter(F.split("spans", ","), lambda x: x != "").alias("spans"))

    def step(text: Column, x: Column) -> Column:
        part = F.split(x, ":")
        start, end = part[1].cast("int"), part[2].cast("int")
        return F.concat(F.substr(text, F.lit(1), start), F.lit("<"), part[0], F.lit(">"), F.substr(text, end + 1))

    wanted = F.filter("spans", lambda x: ~F.split(x, ":")[0].isin(list(keep) or [""]))
    return numbered.join(spans, "row", "left").select("doc_id", F.aggregate(F.reverse(F.coalesce(wanted, F.array().cast("array<string>"))), F.col("text"), step).alias("text"))

