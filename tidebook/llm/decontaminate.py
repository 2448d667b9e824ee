"""Benchmark decontamination with a distributed positional inverted index (DataFrame functions only).

The index is a stored table of postings ``(term, row, pos)``, sorted by term inside every file, so each
file is a shard of the index that holds whole documents. One more posting per document, of the empty
term, stands at position ``n_words``: the document length. Only terms that some test item has can take
part in a match, so `build_index` accepts the test vocabulary and then stores their postings alone.

Search for exact phrases:

1. Count every test term in the index. Each 10-word window of an item is represented by its two rarest
   terms (ties prefer offsets on a fixed grid, so that neighbouring windows share them).
2. The postings of the rarest term, minus its offset in the item, are possible alignments of the item;
   they are intersected with the offset-adjusted postings of the second rarest.
3. For the alignments that are left, the postings of all words of the item are looked up, and runs of at
   least 10 consecutive matching words (the whole item, if shorter) are the exact matches.

Postings are dealt by document and alignment, never by term, so a term or passage that a third of the
corpus has does not gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import ascii_lower, small, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rows up to which a stored side is broadcast (some 20 to 40 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 300_000


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_terms(items: DataFrame) -> DataFrame:
    """Rows ``(item, item_id, m, off, word, term)``, one per word of every item."""
    w = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), words(F.col("text")).alias("w"))
    w = w.select("item", "item_id", F.size("w").alias("m"), F.posexplode("w").alias("off", "word"))
    return stored(w.withColumn("term", F.xxhash64("word")), "items")


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Postings ``(term, row, pos, doc_id, text_hash, is_end)`` of the documents, stored in the shared folder.

    ``row`` numbers the rows of `docs`, so that repeated or null doc_ids stay apart; ``doc_id`` and
    ``text_hash`` are set on the posting of the empty term only, whose ``pos`` is the number of words. `vocabulary` has a column
    ``word``; without it all terms are stored.
    """
    tokens = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), F.concat(words(F.col("text")), F.array(F.lit(""))).alias("w"))
    tokens = tokens.select("row", "doc_id", "text_hash", F.posexplode("w").alias("pos", "word"))
    if vocabulary is None:
        tokens = tokens.withColumn("term", F.xxhash64("word"))
    else:
        end = docs.sparkSession.range(1).select(F.lit("").alias("word"))
        known = vocabulary.select("word").union(end).distinct().withColumn("term", F.xxhash64("word"))
        tokens = tokens.join(small(stored(known.coalesce(1), "terms"), BROADCAST_ROWS), "word")
    postings = tokens.select("term", "row", "pos", F.when(F.col("word") == "", F.col("doc_id")).alias("doc_id"), F.when(F.col("word") == "", F.col("text_hash")).alias("text_hash"), (F.col("word") == "").alias("is_end"))
    return stored(postings.sortWithinPartitions("term", "row", "pos"), "postings")


def document_lengths(index: DataFrame) -> DataFrame:
    return index.filter("is_end").select("row", "doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))


def term_counts(index: DataFrame) -> DataFrame:
    return index.filter("not is_end").groupBy("term").count()


def anchors(terms: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct pairs ``(pair, item, off1, term1, off2, term2)`` of rarest terms of all item windows."""
    length = F.least(F.col("m"), F.lit(window))
    starts = F.sequence(F.greatest(F.lit(0), F.col("off") - length + 1), F.least(F.col("off"), F.col("m") - length))
    counted = terms.join(small(stored(counts, "counts"), BROADCAST_ROWS), "term", "left")
    by_rarity = Window.partitionBy("item", "start").orderBy(F.coalesce("count", F.lit(0)), F.col("off") % window, "off")
    ranked = counted.withColumn("start", F.explode(starts)).withColumn("rank", F.row_number().over(by_rarity)).filter("rank <= 2")
    at = lambda n, what: F.max(F.when(F.col("rank") == n, F.col(what))).alias(f"{what}{n}")
    pairs = ranked.groupBy("item", "start").agg(at(1, "off"), at(1, "term"), at(2, "off"), at(2, "term"))
    return stored(pairs.drop("start").distinct().withColumn("pair", F.monotonically_increasing_id()), "anchors")


def alignments(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct ``(item, row, shift)``: both rarest terms of some window stand at item offset + shift."""
    postings, pairs = index.filter("not is_end"), small(pairs, BROADCAST_ROWS)
    first = postings.join(pairs, F.col("term") == F.col("term1")).select("pair", "item", "row", (F.col("pos") - F.col("off1")).alias("shift"), "off2")
    second = postings.join(pairs, F.col("term") == F.col("term2")).select("pair", "row", (F.col("pos") - F.col("off2")).alias("shift"))
    both = first.filter("off2 is not null").join(second, ["pair", "row", "shift"], "left_semi")
    return stored(both.unionByName(first.filter("off2 is null")).select("item", "row", "shift").distinct(), "alignments")


def exact_matches(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Maximal exact runs ``(row, item, item_id, first, last)`` of at least `window` words of an item.

    Positions are word numbers in the document, both inclusive. An item of fewer words has to match whole.
    """
    found = alignments(index, anchors(items, term_counts(index), window))
    rows = small(stored(found.select("row").distinct(), "rows"), BROADCAST_ROWS)
    near = index.filter("not is_end").join(rows, "row", "left_semi").select("term", "row", "pos")
    wanted = found.join(small(items, BROADCAST_ROWS), "item").select("item", "item_id", "m", "row", "shift", "off", "term", (F.col("shift") + F.col("off")).alias("pos"))
    matched = wanted.filter("pos >= 0").join(near, ["row", "pos", "term"])
    by_offset = Window.partitionBy("row", "item", "shift").orderBy("off")
    runs = matched.withColumn("run", F.col("off") - F.row_number().over(by_offset))
    runs = runs.groupBy("row", "item", "shift", "run").agg(F.first("item_id").alias("item_id"), F.first("m").alias("m"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.filter(F.col("last") - F.col("first") + 1 >= F.least(F.col("m"), F.lit(window))).select("row", "item", "item_id", "first", "last")


def proximity_matches(index: DataFrame, items: DataFrame, slack: int) -> DataFrame:
    """``(row, item, item_id, first, last)`` where the three rarest terms of an item lie within `slack` words.

    ``first`` is the position of the rarest term; the others are at most `slack` words away from it on
    either side. Items with fewer distinct terms use those they have. Positions are joined by blocks of
    `slack` words, so the cost follows the number of postings of the rarest terms.
    """
    rarest = Window.partitionBy("item").orderBy("count", "term")
    terms = items.groupBy("item", "item_id", "term").agg(F.min("off").alias("off")).join(term_counts(index), "term", "left").fillna({"count": 0})
    terms = stored(terms.withColumn("rank", F.row_number().over(rarest)).filter("rank <= 3"), "proximity")
    need = terms.groupBy("item").agg(F.count("*").alias("need"))
    posted = index.filter("not is_end").join(small(terms, BROADCAST_ROWS), "term").select("item", "item_id", "rank", "row", F.col("pos").cast("long").alias("pos"))
    head = posted.filter("rank = 1").select("item", "item_id", "row", F.col("pos").alias("first"), F.explode(F.sequence(F.floor(F.col("pos") / slack) - 1, F.floor(F.col("pos") / slack) + 1)).alias("block"))
    rest = posted.select("item", "row", "rank", "pos", F.floor(F.col("pos") / slack).alias("block"))
    close = head.join(rest, ["item", "row", "block"]).filter(((F.col("rank") == 1) & (F.col("pos") == F.col("first"))) | ((F.col("rank") > 1) & (F.abs(F.col("pos") - F.col("first")) <= slack)))
    found = close.groupBy("row", "item", "item_id", "first").agg(F.countDistinct("rank").alias("have"), F.max("pos").alias("last"))
    return found.join(need, "item").filter("have = need").select("row", "item", "item_id", "first", F.greatest("first", "last").alias("last"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of `docs`: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, row, text_hash``.

    Null or wordless texts have no words and are clean; an item without words matches nothing; repeated
    documents are judged one by one; a null item_id counts as no item in ``n_items`` and the hash, its
    words are hit all the same. Further columns of either table are ignored.
    """
    items = item_terms(benchmark)
    index = build_index(docs, items)
    hits = stored(exact_matches(index, items, window), "hits")
    before = Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first"), F.coalesce(F.max("last").over(before) + 1, F.lit(0))) + 1)
    covered = hits.select("row", "first", "last").distinct().withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = hits.select("row", F.col("item_id").cast("string").alias("item_id")).groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    per_row = covered.join(named, "row")
    none = F.array().cast("array<string>")
    return document_lengths(index).join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("ids", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("ids", none), ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "row", "text_hash",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of a benchmark item occurs, with their own columns.

    A verdict is carried back by doc_id and text together, so rows that share a doc_id but not a text
    are judged apart.
    """
    judged = contamination(docs, benchmark, window).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    dirty = stored(judged, "dirty")
    same = docs["doc_id"].eqNullSafe(dirty["_id"]) & (F.xxhash64(docs["text"]) == dirty["_hash"])
    return docs.join(small(dirty, BROADCAST_ROWS), same, "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, o, o + least(len(w), 10) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS o FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS o FROM d WHERE len(w) > 0),
dw AS (SELECT doc_id, o, n, array_to_string(list_slice(w, o, o + n - 1), ' ') AS g FROM dp, lens WHERE o + n - 1 <= len(w)),
hit AS (SELECT DISTINCT doc_id, item_id, o, n FROM dw JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(o, o + n - 1)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
