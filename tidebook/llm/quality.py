"""Quality rules: a threshold table compiled into one Spark projection (no user functions, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import NON_WHITE, WHITE

#: Symbols that prose rarely has.
SYMBOLS = "#*$%&|<>"
SPAN = 5
#: Frequent function words of English, German, French, Spanish, Italian, Portuguese, Dutch, the Scandinavian
#: languages, Polish and Russian.
STOP_WORDS = (
    "the of and to in is that it was for der die und das ist in den von zu mit de la le et les des en un une que el los del y por las con "
    "il lo di che non per una sono o os as um uma não com para het een van op te niet och att som på är för og at det nie na się jest do и в не что с"
).split()

#: (name, metric, lowest value, highest value); None is no bound. A text passes if every metric is in bounds.
THRESHOLDS = [
    ("words", "n_words", 10, 10_000_000),
    ("length", "mean_word_chars", 1.5, 40.0),
    ("symbols", "symbols_per_word", None, 0.25),
    ("digits", "digit_share", None, 0.3),
    ("stop_words", "stop_word_share", 0.02, None),
    ("lines", "dup_line_share", None, 0.5),
    ("bullets", "bullet_line_share", None, 0.9),
    ("ellipses", "ellipsis_line_share", None, 0.3),
]


def base_columns(text: Column) -> dict[str, Column]:
    """The counts of a text; a null text counts as an empty one."""
    text = F.coalesce(text, F.lit(""))
    no_symbols = F.translate(text, SYMBOLS, "")
    return {
        "words": F.regexp_extract_all(text, F.lit(NON_WHITE), F.lit(0)),
        "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(no_symbols)).cast("long"),
        "n_digits": F.length(text) - F.length(F.translate(text, "0123456789", "")),
        "lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    }


def bound(column: Column, f) -> Column:
    """f of a column, as a let-binding by a one-element array: it is computed once a text, not once an element."""
    return F.element_at(F.transform(F.array(column), f), 1)


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of five words, by its start."""
    def hashes(w: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SPAN)])
        return F.when(F.size(w) < SPAN, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - SPAN), at))

    return bound(words, hashes)


def repeated_words(hashes: Column) -> Column:
    """Words inside windows found at least twice, from the window hashes of a text.

    Windows are sorted by (hash, start); those with an equal neighbour are repeats. Sorted again by start,
    each repeat adds the words that the next one doesn't cover.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, i, j: F.get(a, i)["h"] == F.get(a, j)["h"]
    starts = bound(pairs, lambda a: F.array_sort(F.transform(F.filter(a, lambda x, i: F.coalesce(same(a, i, i - 1), F.lit(False)) | F.coalesce(same(a, i, i + 1), F.lit(False))), lambda x: x["i"])))
    return bound(starts, lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(SPAN), F.coalesce(F.get(s, i + 1) - x, F.lit(SPAN)))), F.lit(0).cast("long"), lambda n, x: n + x))


def compiled(thresholds: list[tuple[str, str, float | None, float | None]]) -> dict[str, Column]:
    """A boolean column ``pass_<name>`` for each row of the threshold table."""
    rules = {}
    for name, metric, low, high in thresholds:
        ok = F.lit(True)
        if low is not None:
            ok = ok & (F.col(metric) >= low)
        if high is not None:
            ok = ok & (F.col(metric) <= high)
        rules[f"pass_{name}"] = ok
    return rules


def judged(docs: DataFrame, thresholds: list[tuple[str, str, float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """Quality counts and verdicts, one row per row of `docs`.

    Columns: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``, the
    metrics and a ``pass_*`` column per threshold, and ``kept``. A null or blank text has no words and
    fails the base rule; its metrics are 0. Rows are judged alone, so repeated rows get equal verdicts;
    further columns are ignored.
    """
    df = docs.select("doc_id", *[c.alias(name) for name, c in base_columns(F.col("text")).items()])
    df = df.withColumn("hashes", window_hashes(F.col("words")))
    df = df.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), F.lit(0).cast("long")).otherwise(repeated_words(F.col("hashes"))).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), "n_digits",
        F.size(F.filter("lines", lambda x: x.rlike(r"^[ \t]*[-*\u2022]"))).alias("n_bullets"), F.size(F.filter("lines", lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("\u2026")))).alias("n_ellipses"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    df = df.select(
        "*", ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        share("word_chars", "n_words").alias("mean_word_chars"), share("n_symbols", "n_words").alias("symbols_per_word"),
        # one more of both, so that a few words without a stop word aren't judged by it
        F.when(F.col("n_words") > 0, (F.col("n_stop") + 1) / (F.col("n_words") + 1)).otherwise(F.lit(0.0)).alias("stop_word_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_digits", "word_chars").alias("digit_share"), share("n_bullets", "n_lines").alias("bullet_line_share"), share("n_ellipses", "n_lines").alias("ellipsis_line_share"),
    )
    rules = compiled(thresholds)
    verdict = ~F.col("base_failed")
    for name in rules:
        verdict = verdict & F.col(name)
    df = df.select("*", *[c.alias(name) for name, c in rules.items()])
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "mean_word_chars", "symbols_per_word", "stop_word_share", "dup_line_share", "digit_share", "bullet_line_share", "ellipsis_line_share", *rules, verdict.alias("kept"))


def oracle(thresholds: list[tuple[str, str, float | None, float | None]] = THRESHOLDS) -> str:
    tests = {name: " AND ".join(f"{metric} {op} {bound}" for op, bound in ((">=", low), ("<=", high)) if bound is not None) for name, metric, low, high in thresholds}
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, o, array_to_string(list_slice(w, o, o + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS o FROM t WHERE len(w) >= 5)),
r AS (SELECT doc_id, o FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(o, o + 4)) AS p FROM r) GROUP BY doc_id),
c AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullets,
      len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipses, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop
      FROM t LEFT JOIN n USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
      CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbols_per_word,
      CASE WHEN n_words > 0 THEN (n_stop + 1) / (n_words + 1) ELSE 0.0 END AS stop_word_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_share,
      CASE WHEN word_chars > 0 THEN n_digits / word_chars ELSE 0.0 END AS digit_share, CASE WHEN n_lines > 0 THEN n_bullets / n_lines ELSE 0.0 END AS bullet_line_share, CASE WHEN n_lines > 0 THEN n_ellipses / n_lines ELSE 0.0 END AS ellipsis_line_share FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, mean_word_chars, symbols_per_word, stop_word_share, dup_line_share, digit_share, bullet_line_share, ellipsis_line_share,
       {", ".join(f"{x} AS pass_{name}" for name, x in tests.items())},
       NOT base_failed AND {" AND ".join(f"({x})" for x in tests.values())} AS kept
FROM m
"""
