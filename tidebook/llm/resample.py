"""Importance resampling towards a target's distribution of hashed word features, over partition-local word tries.

Features are words and pairs of consecutive words; a feature's bucket is the CRC of its bytes. Each task builds a trie of
the words it meets: a node under the root is a word, a node below it the word that follows. Nodes hold their count and the
state of the CRC along their path, so a word's bytes go through the CRC once, and a pair's state is the first word's state
advanced over the second. Counts are added up by bucket and emptied when a trie is full, so a task's memory is bounded.

Bucket totals of documents and target, one row a bucket, give the gains. A second pass walks the same paths with gains
attached to the nodes, and sums them up by document. Draws are by Gumbel top-k: noise from a hash of the doc_id is added to
the weight, and the highest scores are drawn without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidebook.llm.common import stored
from tidebook.llm.vector import texts

BUCKETS = 10_000
#: Documents with fewer words aren't drawn; of the others, so many hundredths are.
MIN_WORDS, PERCENT = 20, 25
SEED = 7
#: Words that a trie holds before it is emptied, and words of text that are walked at once.
TRIE_WORDS, BLOCK = 1 << 18, 1 << 18
_SEPARATORS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters and digits of ASCII and of all that is beyond it, with A-Z lower-cased."""
    return text.translate(_SEPARATORS).split()


@lru_cache(4096)
def shift(n: int) -> np.ndarray:
    """Tables (4, 256) that advance a CRC state over n bytes: a state's bytes look their parts up, and these are xor-ed."""
    if n > 1:
        half = shift(n // 2)
        twice = advanced(advanced(_units(), half), half)
        return _table(advanced(twice, shift(1)) if n % 2 else twice)
    # one zero byte: crc(x + b"\0") and crc(b"\0") differ by just what the state of x adds
    return _table(np.array([_step(1 << k) for k in range(32)], np.uint32))


def _step(state: int) -> int:
    for _ in range(8):
        state = state >> 1 ^ (0xEDB88320 if state & 1 else 0)
    return state


def _units() -> np.ndarray:
    return np.uint32(1) << np.arange(32, dtype=np.uint32)


def _table(units: np.ndarray) -> np.ndarray:
    """The tables of a linear map of 32 bits, from its values for the single bits."""
    bits = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(bool)
    return np.stack([np.bitwise_xor.reduce(np.where(bits, units[8 * k : 8 * k + 8], np.uint32(0)), axis=1) for k in range(4)])


def advanced(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[0][state & np.uint32(255)]
    for k in range(1, 4):
        out ^= table[k][state >> np.uint32(8 * k) & np.uint32(255)]
    return out


class Trie:
    """Words and the words after them, with a count and a CRC state at each node.

    A word's node is its number, in order of appearance. A pair's node is found from both numbers; pairs are only kept
    for the block of text that is walked, as nearly every block has new ones.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.state, self.open, self.length = (np.empty(0, t) for t in (np.uint32, np.uint32, np.int64))

    def numbered(self, words: list[bytes]) -> np.ndarray:
        """Nodes of some words; new ones are entered with their states."""
        numbers = self.numbers
        known = len(numbers)
        nodes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        new = list(numbers)[known:] if len(numbers) > known else []
        if new:
            state = [zlib.crc32(w) for w in new]
            self.state = np.concatenate([self.state, np.array(state, np.uint32)])
            #: the state after the space that a next word follows
            self.open = np.concatenate([self.open, np.array([zlib.crc32(b" ", s) for s in state], np.uint32)])
            self.length = np.concatenate([self.length, np.array([len(w) for w in new], np.int64)])
        return nodes

    def pair_states(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """CRC states of the nodes of word pairs: the open state of the first word, advanced over the second."""
        out, lengths = np.empty(len(first), np.uint32), self.length[second]
        order = np.argsort(lengths, kind="stable")
        sizes, starts = np.unique(lengths[order], return_index=True)
        for n, start, end in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=False):
            at = order[start:end]
            out[at] = advanced(self.open[first[at]], shift(n))
        return out ^ self.state[second]

    def paths(self, words: list[bytes], follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes of a block's words and pairs, as (word nodes, pair nodes by pair, first and second word of each pair node).

        `follows` marks words that come after another word of their text.
        """
        nodes = self.numbered(words)
        code = nodes[:-1][follows[1:]] << 32 | nodes[1:][follows[1:]]
        pairs, at = np.unique(code, return_inverse=True)
        return nodes, at, pairs >> 32, pairs & 0xFFFFFFFF


def blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """Words of the texts in blocks: (texts so far, text of each word, words, which follow another, which are new).

    A block that starts within a text starts with the last word of the block before, which isn't new.
    """
    words: list[bytes] = []
    owner: list[np.ndarray] = []
    n, seen = 0, 0

    def block(carried: bool):
        text = np.concatenate(owner) if owner else np.empty(0, np.int64)
        follows = np.zeros(len(text), bool)
        follows[1:] = text[1:] == text[:-1]
        new = np.ones(len(text), bool)
        new[:1] = not carried
        return seen, text, words, follows, new

    carried = False
    for batch in batches:
        for text in texts(batch.column(column)):
            found = words_of(text)
            for at in range(0, len(found), BLOCK):
                part = found[at : at + BLOCK]
                words += part
                owner.append(np.full(len(part), seen, np.int64))
                n += len(part)
                if n >= BLOCK:
                    yield block(carried)
                    more = at + BLOCK < len(found)
                    words, owner, n = (words[-1:], [owner[-1][-1:]], 1) if more else ([], [], 0)
                    carried = more
            seen += 1
    yield block(carried)


def bucket_counts(buckets: int):
    """A task's part: feature counts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = Trie(), np.zeros(buckets, np.int64)
        for _, _, words, follows, new in blocks(batches, "text"):
            nodes, pair, first, second = trie.paths(words, follows)
            times = np.bincount(nodes[new], minlength=len(trie.state))
            used = np.flatnonzero(times)
            np.add.at(total, trie.state[used] % np.uint32(buckets), times[used])
            np.add.at(total, trie.pair_states(first, second) % np.uint32(buckets), np.bincount(pair, minlength=len(first)))
            if len(trie.numbers) > TRIE_WORDS:
                trie.clear()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return count


def bucket_totals(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: the features of all texts by bucket; buckets without any have no row."""
    return docs.select("text").mapInArrow(bucket_counts(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: 1000 times the logarithm of its share of the target over its share of the documents.

    One row a bucket goes to the driver, so its size is the parameter `buckets`. Shares are smoothed by one a bucket.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for into, df in ((s, docs), (t, target)):
        for row in bucket_totals(df, buckets).collect():
            into[row["bucket"]] = row["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def walked(gain: np.ndarray):
    """A task's part: each document's words, features and sum of gains."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, ids = Trie(), []
        words_n, features, total = (np.zeros(0, np.int64) for _ in range(3))

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids.append(batch.column("doc_id"))
                yield batch

        done = 0
        for seen, text, words, follows, new in blocks(kept(batches), "text"):
            nodes, pair, first, second = trie.paths(words, follows)
            word_gain = gain[trie.state % np.uint32(len(gain))]
            pair_gain = gain[trie.pair_states(first, second) % np.uint32(len(gain))]
            size = sum(map(len, ids))
            grow = size - len(words_n)
            words_n, features, total = (np.concatenate([x, np.zeros(grow, np.int64)]) for x in (words_n, features, total))
            at = text - done
            for of, value in ((at[new], word_gain[nodes[new]]), (at[follows], pair_gain[pair])):
                np.add.at(total, of, value)
                features += np.bincount(of, minlength=size)
            words_n += np.bincount(at[new], minlength=size)
            if len(trie.numbers) > TRIE_WORDS:
                trie.clear()
            # documents before the one that the block ended in are complete
            if complete := min(seen - done, size):
                column = pa.concat_arrays(ids)
                yield scored(column[:complete], words_n[:complete], features[:complete], total[:complete])
                ids[:] = [column[complete:]]
                words_n, features, total, done = words_n[complete:], features[complete:], total[complete:], done + complete

    def scored(ids, words_n, features, total):
        weight = np.where(features > 0, np.floor_divide(total, np.maximum(features, 1)), 0)
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *map(pa.array, (words_n, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return walk


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean of gains over a document's features; 0 without any."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return df.mapInArrow(walked(gain), "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of the seed and the doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Rows with a `rank` from 1 in the order given: sorted by ranges, and numbered from the row counts of the ranges before.

    The sorted rows are written first, so numbers and counts are of the same rows. One row a range is summed up in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = F.monotonically_increasing_id()
    kept = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("range", F.shiftright(local, 33)).withColumn("at", local.bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    counts = kept.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    return kept.join(F.broadcast(before), "range").select(*df.columns, (F.col("before") + F.col("at") + 1).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Scores of all documents, and the rank of those drawn: ``doc_id, n_words, n_features, weight, score, rank``.

    Of the documents with at least `min_words` words, the `percent` hundredths (rounded down) with the highest scores are
    drawn; ties go to the smaller doc_id, null ids first, and are otherwise arbitrary (such rows are equal). Others have a
    null rank. A null or empty text has no words, no features and weight 0. A null doc_id hashes as an empty one. Repeated
    rows are documents of their own, with equal scores. An empty table gives an empty result, an empty target gains that
    favour what documents lack. Texts of any length are walked in blocks, and further columns are ignored.
    """
    scored = weights(docs, gains(docs, target, buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored, "weights")
    able = F.col("n_words") >= min_words
    drawn = scored.filter(able).count() * percent // 100
    sure = ranked(scored.filter(able), F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    sure = sure.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return sure.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """The rows of `docs` that `resampled` drew, with all their columns; rows that share a doc_id are drawn together."""
    ids = scores.filter("rank is not null").select(F.col("doc_id").alias("drawn"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["drawn"]), "left_semi")
