"""Removal of lines that many documents share, over a levelled store of sorted runs of line hashes.

A run is a sorted table of ``key, n_docs, last_doc``: the 128-bit hash of a line's key, in how many documents it was
found, and the largest doc_id of these. Documents come in batches. A batch's lines are summed up by key, merge-anti-joined
with the runs and written as a run of level 0; `FANOUT` runs of a level are merged into one of the next, so each entry is
rewritten once a level. A key may have entries in several runs; together they count.

What the anti-join leaves out is what can't change a verdict: a run that alone has the key in enough documents, one of them
no smaller than the batch's, has settled it. Batches that come by falling doc_id so leave out every line known to be frequent.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import LOWER, UPPER, WHITE, ascii_lower, shared_dir, stored
from tidebook.llm.quality import bound

#: Code points of the shortest key that counts, and the documents that make a line frequent.
MIN_CHARS, MIN_DOCS = 40, 5
#: Batches of a whole table, and runs of a level that are merged into one.
BATCHES, FANOUT = 6, 3
#: Lines in more than one of so many documents are joined by broadcast: there can't be more such lines than this.
HOT = 10_000


class LineRuns:
    """Sorted runs of line hashes in a folder; each change writes a new version of the list of runs.

    The folder may hold runs of earlier sessions, which count. Runs that a merge replaced stay until the folder is deleted.
    """

    def __init__(self, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.path, self.min_docs, self.fanout = spark, path, min_docs, fanout
        try:
            listed = spark.read.schema("level int, run string, version long").json(f"{path}/manifest")
            rows = listed.filter(F.col("version") == listed.agg(F.max("version")).first()[0]).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        self.runs = [(r["level"], r["run"]) for r in rows]
        self.version = rows[0]["version"] if rows else 0

    def read(self, runs: list[tuple[int, str]]) -> DataFrame:
        return self.spark.read.schema("key binary, n_docs long, last_doc long").parquet(*[f"{self.path}/{run}" for _, run in runs])

    def _write(self, df: DataFrame, level: int) -> tuple[int, str]:
        run = f"level-{level}-{uuid.uuid4().hex}"
        df.sortWithinPartitions("key").write.parquet(f"{self.path}/{run}")
        return level, run

    def add(self, entries: DataFrame) -> None:
        """Add a batch of lines: rows of ``key, doc_id, first``, of which the first of each document and key count."""
        batch = entries.groupBy("key").agg(F.sum(F.col("first").cast("long")).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if self.runs:
            known = self.read(self.runs).filter(F.col("n_docs") >= self.min_docs).select(F.col("key").alias("known"), F.col("last_doc").alias("known_last"))
            settled = (F.col("key") == F.col("known")) & (F.col("last_doc").isNull() | (F.col("known_last") >= F.col("last_doc")))
            batch = batch.join(known.hint("merge"), settled, "left_anti")
        self.runs.append(self._write(batch, 0))
        level = 0
        while len(full := [r for r in self.runs if r[0] == level]) >= self.fanout:
            merged = self._write(self._summed(self.read(full)), level + 1)
            self.runs = [r for r in self.runs if r not in full] + [merged]
            level += 1
        self.version += 1
        self.spark.createDataFrame(self.runs, "level int, run string").coalesce(1).write.json(f"{self.path}/manifest/version={self.version}")

    def _summed(self, df: DataFrame) -> DataFrame:
        return df.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def frequent(self) -> DataFrame:
        """``key, n_docs, last_doc`` of the keys in enough documents. n_docs is a lower bound that reaches the threshold."""
        if not self.runs:
            return self.spark.createDataFrame([], "key binary, n_docs long, last_doc long")
        return self._summed(self.read(self.runs)).filter(F.col("n_docs") >= self.min_docs)


def split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_entries(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line whose key is long enough: ``doc_id, part, pos, first, key``.

    `part` is the hash of the text, `pos` counts a text's lines from 0, `first` marks a key's first line in its text.
    """
    keys = F.transform(split(ascii_lower(F.col("text"))), lambda x: F.btrim(x, F.lit(WHITE)))
    long = F.filter(F.transform(keys, lambda x, i: F.struct(x.alias("line"), i.alias("pos"))), lambda x: F.length(x["line"]) >= min_chars)
    marked = bound(F.sort_array(long), lambda a: F.transform(a, lambda x, i: F.struct(x["line"].alias("line"), x["pos"].alias("pos"), (~F.coalesce(F.get(a, i - 1)["line"] == x["line"], F.lit(False))).alias("first"))))
    df = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("part"), F.explode(marked).alias("x"))
    return df.select("doc_id", "part", "x.pos", "x.first", F.unhex(F.md5("x.line")).alias("key"))


def in_batches(docs: DataFrame, entries: DataFrame, batches: int) -> list[DataFrame]:
    """The entries in batches by falling doc_id, written once; null ids come last."""
    bounds = docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.02) if batches > 1 else []
    number = sum((F.coalesce((F.col("doc_id") < int(b)).cast("int"), F.lit(1)) for b in set(bounds)), F.lit(0))
    kept = stored(entries.withColumn("batch", number), "lines", "batch")
    return [kept.filter(F.col("batch") == k).drop("batch") for k in range(len(set(bounds)) + 1)] + [kept.drop("batch")]


def dropped_lines(entries: DataFrame, frequent: DataFrame) -> DataFrame:
    """Rows of `entries` (stored) whose key is frequent and kept by a larger doc_id.

    A key with more than 1 / `HOT` of all lines would be a large task of a shuffled join. There can't be more than `HOT` such
    keys, whatever the size of the corpus, so these are broadcast, and the rest meets in a join by key.
    """
    lost = F.col("doc_id").isNull() & F.col("last_doc").isNotNull() | (F.col("doc_id") < F.col("last_doc"))
    total = entries.count()
    hot = F.col("n_docs") * HOT > total
    few, rest = F.broadcast(frequent.filter(hot).select("key", "last_doc")), frequent.filter(~hot).select("key", "last_doc")
    return entries.join(few, "key").filter(lost).unionByName(entries.join(few, "key", "left_anti").join(rest, "key").filter(lost))


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, store: LineRuns | None = None) -> DataFrame:
    """Texts without the lines that `min_docs` documents or more share: ``doc_id, n_lines, n_dropped, kept``.

    Texts are split at newlines. A line's key is the line without white space at both ends, A-Z lower-cased. A key of at
    least `min_chars` code points in at least `min_docs` documents loses all its lines but those of the largest doc_id that
    has it. With a `store`, its earlier documents count too, and this batch's are added to it.

    Each row is a document, repeated rows too; rows that share the largest doc_id all keep their lines. A null doc_id is
    smaller than all others; where all are null, nothing is lost. A null or empty text is one empty line. An empty table
    gives an empty result. Texts of any length are split whole, and further columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    store = store or LineRuns(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/line-runs-{uuid.uuid4().hex}", min_docs)
    *parts, entries = in_batches(docs, line_entries(docs, min_chars), batches)
    for part in parts:
        store.add(part)
    frequent = stored(store.frequent(), "frequent-lines")
    gone = dropped_lines(entries, frequent).groupBy(F.col("doc_id").alias("id"), F.col("part").alias("of")).agg(F.collect_set("pos").alias("gone"))
    df = docs.withColumn("part", F.xxhash64(F.coalesce("text", F.lit(""))))
    df = df.join(gone, df["doc_id"].eqNullSafe(gone["id"]) & (df["part"] == gone["of"]), "left")
    kept = bound(split(F.col("text")), lambda a: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("gone")), lambda i: F.get(a, i)), "\n"))
    text = F.coalesce("text", F.lit(""))
    n = (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long")
    return df.select("doc_id", n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("gone").isNull(), text).otherwise(kept).alias("kept"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT r, doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM (SELECT DISTINCT r, doc_id, key FROM k WHERE length(key) >= {MIN_CHARS}) GROUP BY key HAVING count(*) >= {MIN_DOCS}),
x AS (SELECT k.*, f.key IS NOT NULL AND (doc_id < last OR doc_id IS NULL AND last IS NOT NULL) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY r, doc_id
"""
