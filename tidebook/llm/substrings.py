"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are sorted only through `WIDTH` bytes, most significant digit first, and a suffix that is alone
with its digits so far leaves the sort; what is equal after the last digit is exactly what repeats. Sorting
one row per byte would shuffle many times the corpus, so the digits of a string are chosen to let whole
runs of neighbouring suffixes share one row. Equal strings have equal digits whichever digit comes first,
and the first digit of a string is its *anchor*: of all `GRAM`-byte strings that start in its first `REACH`
bytes, the one with the smallest hash (the first of equals). Neighbouring strings mostly have one anchor,
so an anchor stands for a run of starts.

    digit 1   the anchor's `GRAM` bytes: an anchor nobody else has drops its whole run
    digit 2   all bytes that the strings of the run cover, with the anchor's place in them: runs that are
              equal here repeat as a whole, and are done
    digit 3   the run cut into blocks of `BLOCK` offsets: a block whose common bytes are unique is dropped,
              one whose bytes are all equal to another's is done
    digit 4   single offsets: the strings themselves

Digits are 128-bit hashes of the bytes (64 bits for digit 1, which only preselects). Rows are dealt by
digit; counts are pre-aggregated in every task, and each group's count is joined back, so a passage that a
third of the corpus has makes no large task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import small, stored
from tidebook.llm.vector import G, mix, texts

WIDTH = 400
REACH = 256
BLOCK = 16
#: Starts that are hashed at once.
PIECE = 1 << 18
#: A text is found again by two hashes of its doc_id and bytes. Rows equal in both are copies of each other.
KEY = ["row", "row2"]
#: Broadcast bounds: repeated grams (8 bytes each), and runs or spans of all texts (some 40 bytes each).
BROADCAST_GRAMS, BROADCAST_SPANS = 1_000_000, 500_000

CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(7)) * G) | np.uint64(1)
BASE = 0xD6E8FEB86659FD93
_UP: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if n not in _UP:
        _UP.clear()
        grow = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, dtype=np.uint64))])
        _UP[n] = grow(BASE), grow(pow(BASE, -1, 1 << 64))
    return _UP[n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each `gram` bytes of some data, by start."""
    up, down = _powers(PIECE + 4096 * (1 + gram // 2048))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * up[: len(data)], out=total[1:])
    n = len(data) - gram + 1
    return mix((total[gram:] - total[:n]) * down[:n])


def anchors(data: np.ndarray, width: int = WIDTH, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of `width`-byte strings with one anchor: the anchor, the first and last start, the gram's hash."""
    starts = len(data) - width + 1
    if starts <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64)
    gram, found = width - reach + 1, []
    for at in range(0, starts, PIECE):
        n = min(PIECE, starts - at)
        hashes = gram_hashes(data[at : at + n + width - 1], gram)
        # the smallest of reach neighbours, by doubling; the low bits hold the place, so the first of equals wins
        place = np.arange(len(hashes), dtype=np.uint64)
        least, span = (hashes & ~np.uint64(0xFFFFF)) | place, 1
        while span < reach:
            step = min(span, reach - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        anchor = (least & np.uint64(0xFFFFF)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        found.append((anchor[edge] + at, edge + at, np.append(edge[1:], n) - 1 + at, hashes[anchor[edge]]))
    place, first, last, gram_hash = (np.concatenate(x) for x in zip(*found, strict=True))
    # a run that goes on in the next piece is one run
    new = np.concatenate([[True], place[1:] != place[:-1]])
    ends = np.append(np.flatnonzero(new)[1:], len(place)) - 1
    return place[new], first[new], last[ends], gram_hash[new]


def _digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _runs(batches: Iterator[pa.RecordBatch], width: int, reach: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for row, row2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
            place, first, last, gram = anchors(np.frombuffer(text, np.uint8), width, reach)
            for column, x in zip(out, (np.full(len(place), row), np.full(len(place), row2), place, first, last, gram.view(np.int64)), strict=False):
                column.append(x)
            # the anchor's place in the run is part of the digit, as are both lengths
            out[6] += [_digest(b"%d %d " % (p - a, z - a) + text[a : z + width]) for p, a, z in zip(place.tolist(), first.tolist(), last.tolist(), strict=True)]
        columns = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out[:6]]
        yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in columns], pa.array(out[6], pa.binary())], [*KEY, "place", "first", "last", "gram", "run"])


def _contexts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The bytes of runs that go on to the next digit."""
    for batch in batches:
        for row, row2, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            for at in range(0, len(runs), 1000):
                part = runs[at : at + 1000]
                columns = [pa.array([x] * len(part), pa.int64()) for x in (row, row2)] + [pa.array([r[k] for r in part], pa.int64()) for k in ("place", "first", "last", "gram")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([text[r["first"] : r["last"] + width] for r in part], pa.binary())], [*KEY, "place", "first", "last", "gram", "bytes"])


def _blocks(batches: Iterator[pa.RecordBatch], width: int, block: int) -> Iterator[pa.RecordBatch]:
    """Each run cut where the distance to the anchor is a multiple of `block`: ``core`` hashes the bytes that all
    strings of a whole block share, ``hull`` those that the strings here cover."""
    longs, names = [*KEY, "place", "first", "last"], [*KEY, "place", "first", "last", "core", "hull"]
    for batch in batches:
        out: list[tuple] = []
        for row, row2, place, first, last, gram, data in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            head = b"%d " % gram
            for b in range((place - last) // block, (place - first) // block + 1):
                # offsets b*block .. b*block+block-1 before the anchor; starts a..z of those are in the run
                a, z = max(first, place - b * block - block + 1), min(last, place - b * block)
                core = data[place - b * block - first : place - b * block - block + 1 - first + width]
                hull = data[a - first : z - first + width]
                out.append((row, row2, place, a, z, _digest(head + b"%d " % b + core), _digest(head + b"%d %d " % (place - a, place - z) + hull)))
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in longs else pa.binary()) for c, n in zip(columns, names, strict=True)], names)


def repeated(df: DataFrame, digit: str) -> DataFrame:
    """Stored: the values of a digit that at least two rows have."""
    counts = df.groupBy(digit).agg(F.count("*").alias("n")).filter("n > 1").select(digit)
    return stored(counts, f"repeats-{digit}")


def with_lists(docs: DataFrame, lists: DataFrame, column: str, how: str) -> DataFrame:
    """Texts with an array each, joined by `KEY`; the arrays are broadcast if all together they are small."""
    n = lists.agg(F.coalesce(F.sum(F.size(column) + 1), F.lit(0))).first()[0]
    return docs.join(F.broadcast(lists) if n <= BROADCAST_SPANS else lists, KEY, how).select(*KEY, "text", column)


def repeated_spans(texts_: DataFrame, width: int = WIDTH, reach: int = REACH, block: int = BLOCK) -> DataFrame:
    """``row, row2, first, last`` of starts of `width`-byte strings that occur again; the input is ``row, row2, text``."""
    longs = "row bigint, row2 bigint, place bigint, first bigint, last bigint"
    starts, keyed = [*KEY, "first", "last"], [*KEY, "place", "first", "last", "gram"]
    runs = stored(texts_.mapInArrow(lambda b: _runs(b, width, reach), f"{longs}, gram bigint, run binary"), "suffix-runs")
    alive = stored(runs.join(small(repeated(runs, "gram"), BROADCAST_GRAMS), "gram"), "suffix-alive")
    alive = stored(alive.join(repeated(alive, "run").withColumn("whole", F.lit(True)), "run", "left"), "suffix-runs-2")
    spans = alive.filter("whole").select(starts)
    # next digit: runs that aren't done, and, for them to be found equal to, one run of each kind that is
    single = alive.filter("whole is null").select(keyed)
    open_grams = stored(single.select("gram").distinct(), "suffix-open")
    kinds = alive.filter("whole").join(open_grams, "gram", "left_semi").groupBy("run").agg(F.min(F.struct(keyed)).alias("r")).select("r.*")
    ahead = stored(single.unionByName(kinds).groupBy(KEY).agg(F.collect_list(F.struct("place", "first", "last", "gram")).alias("runs")), "suffix-ahead")
    data = stored(with_lists(texts_, ahead, "runs", "inner").mapInArrow(lambda b: _contexts(b, width), f"{longs}, gram bigint, bytes binary"), "suffix-bytes")
    part = f"{longs}, core binary, hull binary"
    blocks = stored(data.mapInArrow(lambda b: _blocks(b, width, block), part), "suffix-blocks")
    blocks = stored(blocks.join(repeated(blocks, "core"), "core", "left_semi"), "suffix-blocks-alive")
    blocks = stored(blocks.join(repeated(blocks, "hull").withColumn("whole", F.lit(True)), "hull", "left"), "suffix-blocks-2")
    spans = spans.unionByName(blocks.filter("whole").select(starts))
    # last digit: of cores that some unfinished block has, the single strings of all blocks, finished ones once
    left = blocks.filter("whole is null")
    open_cores = stored(left.select("core").distinct(), "suffix-open-cores")
    reps = blocks.filter("whole").join(open_cores, "core", "left_semi").groupBy("hull").agg(F.min(F.struct(*KEY, "place", "first", "last")).alias("r")).select("r.*")
    pick = stored(left.select(*KEY, "place", "first", "last").unionByName(reps), "suffix-pick").withColumnsRenamed({"first": "a", "last": "z"})
    cut = F.substring("bytes", (F.col("a") - F.col("first") + 1).cast("int"), (F.col("z") - F.col("a") + width).cast("int"))
    strings = data.dropDuplicates([*KEY, "place"]).join(pick, [*KEY, "place"]).select(*KEY, "place", F.col("a").alias("first"), F.col("z").alias("last"), "gram", cut.alias("bytes"))
    singles = stored(strings.mapInArrow(lambda b: _blocks(b, width, 1), part).select(*starts, "hull"), "suffix-strings")
    return spans.unionByName(singles.join(repeated(singles, "hull"), "hull", "left_semi").select(starts))


def _kept(batches: Iterator[pa.RecordBatch], width: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        out: list[tuple] = []
        for text, spans in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for s in spans or ():  # sorted; those that touch are one
                a, z = s["first"], s["last"] + width
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            ends = [0, *(z for _, z in merged)]
            kept = b"".join(text[z:a] for z, a in zip(ends, [*(a for a, _ in merged), len(text)], strict=True))
            out.append((len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)


def deduplicated(docs: DataFrame, width: int = WIDTH, reach: int = REACH, block: int = BLOCK, with_text: bool = True) -> DataFrame:
    """One row per row of `docs`: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    Every byte that a `width`-byte string covers which also starts anywhere else in the input, in the same
    or another row, is removed; ``kept`` (null without `with_text`) has the other bytes. A null text is
    empty. Repeated rows are copies of each other and lose their texts of at least `width` bytes. A text
    shorter than that keeps all. Further columns are ignored; an empty table gives no rows.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit(1), "text", "doc_id").alias("row2"))
    spans = repeated_spans(keyed.select(*KEY, "text"), width, reach, block)
    spans = stored(spans.groupBy(KEY).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans")), "suffix-spans")
    n = spans.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0]
    found = keyed.join(F.broadcast(spans) if n <= BROADCAST_SPANS else spans, KEY, "left").select("doc_id", "text", "spans")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(lambda b: _kept(b, width, with_text), f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
