"""Token-ID output as a content-addressed store.

A store is a folder of three Parquet tables:

``chunks``    ``digest, ids``: each distinct run of ids once, little-endian, two bytes an id if the
              vocabulary fits, else four
``recipes``   ``part, seq, doc_id, n_tokens, start, digests, leaf``: documents in ascending doc_id order, the
              chunks that make up each, and the ids of all documents before it
``manifest``  ``part, n_docs, n_tokens, root``: the Merkle root over the leaves of each part of the recipes

Chunks end where a rolling hash of the last `TAPS` ids has `MASK` zero bits, so equal passages are cut alike
wherever they stand, and at `LONGEST` ids at the latest. A chunk's digest verifies its ids, a leaf its
document's list of digests, a root the leaves and their order.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm.common import shared_dir, small, stored
from tidebook.llm.vector import G, mix, texts

END = 2
TAPS = 8
MASK = np.uint64((1 << 9) - 1)
LONGEST = 4096
BROADCAST_ROWS = 300_000
#: Pieces of text whose ids a Python worker keeps, some 40 bytes each; beyond them it starts anew.
KEPT_PIECES = 2_000_000
SLOTS = 1 << 22
#: Bytes of pieces that are kept, and of the longest piece that is looked up.
KEPT_BYTES, LONG_PIECE = 1 << 26, 256
#: Bytes of text that are looked up at once; temporaries take some 40 bytes a byte.
SPAN = 1 << 20

#: The pre-tokenizer of byte-level BPE with its usual pattern. Only with it, and without a normalizer, ids of
#: pieces put together are the ids of the text: its tokens never go across the start of a run of spaces and
#: newlines, nor from a newline to what follows it, if no other white space is near.
PIECEWISE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Texts with other white space, or with what may begin a special token, are encoded whole.
WHOLE = re.compile("[^\\S \n]|[\u180e\u200b\ufeff]|<\\|")
#: Bytes that a match of WHOLE begins with, "<|" apart: most texts have none of them.
RARE = np.zeros(256, dtype=bool)
RARE[:32] = RARE[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
RARE[10] = False


class Encoder:
    """The ids of texts by a tokenizers file, with those of frequent pieces kept.

    A piece is a run of spaces and newlines, the last newline before a word, or a word with the spaces before it. Pieces
    are looked up by a 64-bit hash of their bytes, for a whole batch of texts at once: a slot of the hash names
    the entry that took it last, and the entry's bytes are compared. What isn't there is encoded, new words together
    as lines of one text. Pieces longer than `LONG_PIECE` aren't looked up at all.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.piecewise = spec["normalizer"] is None and PIECEWISE.items() <= (spec["pre_tokenizer"] or {}).items() and len(line) == 1
        self.line = line[0] if line else None
        self.clear()

    def clear(self) -> None:
        """No entries but one that no piece has."""
        self.n, self.slots = 1, np.zeros(SLOTS, np.int32)
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.n_ids, self.ids = 0, np.empty(1 << 16, self.dtype)
        self.at, self.lengths, self.heads = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.uint64)
        self.n_bytes, self.bytes = 0, np.zeros(1 << 16, np.uint8)

    def same(self, words: np.ndarray, at: np.ndarray, heads: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether pieces at some starts are those of some entries: by size and first 8 bytes, and by the others where there are more."""
        equal = (self.heads[place] == heads) & (self.lengths[place] == sizes)
        left, done, kept = np.flatnonzero(equal & (sizes > 8)), 8, packed(self.bytes)
        while len(left):
            differ = cut(words[at[left] + done] ^ kept[self.at[place[left]] + done], sizes[left] - done) != 0
            equal[left[differ]] = False
            done += 8
            left = left[~differ & (sizes[left] > done)]
        return equal

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def add(self, keys: np.ndarray, heads: np.ndarray, pieces: list[bytes]) -> int:
        """Encode pieces and enter their ids; returns the number of the first entry."""
        plain = np.array([b"\n" not in x and not x.startswith(b"  ") and not x.endswith(b" ") for x in pieces], bool)
        words, rest = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        sizes = np.zeros(len(pieces), np.int64)
        ids = []
        if words:
            found = self.encoded([b"\n".join([*(pieces[i] for i in words), b""]).decode()])[0]
            sizes[words] = np.diff(np.flatnonzero(found == self.line), prepend=-1) - 1
            ids.append(found[found != self.line])
        others = self.encoded([pieces[i].decode() for i in rest])
        sizes[rest] = [len(x) for x in others]
        order = np.array(words + rest)
        starts = np.empty(len(pieces), np.int64)
        starts[order] = self.n_ids + np.cumsum(sizes[order]) - sizes[order]
        ids = np.concatenate([*ids, *others])
        first, end, end_ids = self.n, self.n + len(pieces), self.n_ids + len(ids)
        self.starts, self.sizes, self.ids = (grown(x, n) for x, n in ((self.starts, end), (self.sizes, end), (self.ids, end_ids)))
        self.starts[first:end], self.sizes[first:end], self.ids[self.n_ids : end_ids] = starts, sizes, ids
        lengths = np.array([len(x) for x in pieces], np.int64)
        self.at, self.lengths, self.heads, self.bytes = grown(self.at, end), grown(self.lengths, end), grown(self.heads, end), grown(self.bytes, self.n_bytes + int(lengths.sum()) + 8)
        self.at[first:end], self.lengths[first:end], self.heads[first:end] = self.n_bytes + np.cumsum(lengths) - lengths, lengths, heads
        self.bytes[self.n_bytes : self.n_bytes + int(lengths.sum())] = np.frombuffer(b"".join(pieces), np.uint8)
        self.n_bytes += int(lengths.sum())
        self.slots[(keys & np.uint64(SLOTS - 1)).view(np.int64)] = np.arange(first, end)
        self.n, self.n_ids = end, end_ids
        return first

    def looked_up(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of some non-empty texts that need not be encoded whole."""
        whole = b"".join(texts)
        data = np.frombuffer(whole, np.uint8)
        bounds = np.cumsum([0] + [len(x) for x in texts])
        white = (data == 32) | (data == 10)
        first = np.ones(len(data), bool)
        # a run begins after a word, and a word after a newline
        first[1:] = white[1:] & ~white[:-1]
        # of a run before a word the pre-tokenizer takes the last newline alone
        after = ~white[1:] & (data[:-1] == 10)
        after[bounds[1:-1] - 1] = False
        first[1:] |= after
        first[:-1] |= after
        first[bounds[:-1]] = True
        at = np.flatnonzero(first)
        if self.n > KEPT_PIECES or self.n_bytes > KEPT_BYTES:
            self.clear()
        lengths, words = np.diff(at, append=len(data)), packed(np.concatenate([data, np.zeros(8, np.uint8)]))
        heads = cut(words[at], lengths)
        short = lengths <= LONG_PIECE
        keys = mix(heads + lengths.astype(np.uint64) * G)
        left, done = np.flatnonzero(short & (lengths > 8)), 8
        while len(left):
            keys[left] = mix(keys[left] * G + cut(words[at[left] + done], lengths[left] - done))
            done += 8
            left = left[lengths[left] > done]
        place = self.slots[(keys & np.uint64(SLOTS - 1)).view(np.int64)].astype(np.int64)
        pieces = lambda i: [whole[a:z] for a, z in zip(at[i].tolist(), (at[i] + lengths[i]).tolist(), strict=True)]
        lost = np.flatnonzero(short & ~self.same(words, at, heads, lengths, place))
        if len(lost):
            new, where, which = np.unique(keys[lost], return_index=True, return_inverse=True)
            place[lost] = which + self.add(new, heads[lost[where]], pieces(lost[where]))
            # other pieces of one hash
            short[lost] = self.same(words, at[lost], heads[lost], lengths[lost], place[lost])
        alone = np.flatnonzero(~short)
        if len(alone):
            place[alone] = np.arange(len(alone)) + self.add(keys[alone], heads[alone], pieces(alone))
        sizes = self.sizes[place].astype(np.int64)
        ids = self.ids[spread(self.starts[place], sizes)]
        ends = np.cumsum(sizes)[np.append(np.searchsorted(at, bounds[1:-1]), len(at)) - 1]
        return np.split(ids, ends[:-1])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        out = [np.empty(0, self.dtype)] * len(texts)
        whole = [i for i, x in enumerate(texts) if not self.piecewise or needs_whole(x)]
        for i, ids in zip(whole, self.encoded([texts[i].decode() for i in whole]), strict=True):
            out[i] = ids
        alone = set(whole)
        parts = [(i, part) for i, x in enumerate(texts) if i not in alone for part in spans(x)]
        found: dict[int, list[np.ndarray]] = {}
        while parts:
            n, size = 0, 0
            while n < len(parts) and (not n or size + len(parts[n][1]) <= SPAN):
                size += len(parts[n][1])
                n += 1
            for (i, _), ids in zip(parts[:n], self.looked_up([x for _, x in parts[:n]]), strict=True):
                found.setdefault(i, []).append(ids)
            parts = parts[n:]
        for i, ids in found.items():
            out[i] = np.concatenate(ids)
        return out


def packed(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte of some data on, as one number, but for the last 7."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def cut(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Packed bytes of which only the first of some sizes count."""
    return words << (np.uint64(64) - np.uint64(8) * np.minimum(sizes, 8).astype(np.uint64))


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n items."""
    return x if n <= len(x) else np.concatenate([x, np.empty(max(n - len(x), len(x)), x.dtype)])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all items of runs, one run after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def needs_whole(text: bytes) -> bool:
    return b"<|" in text or bool(RARE[np.frombuffer(text, np.uint8)].any() and WHOLE.search(text.decode()))


def spans(text: bytes) -> Iterator[bytes]:
    """A text in parts of some `SPAN` bytes that end where pieces do; nothing for an empty text."""
    at = 0
    while at < len(text):
        end = at + SPAN
        while end < len(text):
            data = np.frombuffer(text[at:end], np.uint8)
            white = (data == 32) | (data == 10)
            gaps = np.flatnonzero(white[1:] & ~white[:-1])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end += SPAN
        yield text[at:end]
        at = end


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    x = mix((ids.astype(np.uint64) + np.uint64(1)) * G)
    h, shift = x.copy(), np.uint64(1)
    for k in range(1, min(TAPS, len(x))):
        h[k:] += x[:-k] << (shift * np.uint64(k))
    found, start = [], 0
    for end in [*(np.flatnonzero((h >> np.uint64(40)) & MASK == 0) + 1).tolist(), len(ids)]:
        while end - start > LONGEST:
            start += LONGEST
            found.append(start)
        if end > start:
            found.append(end)
            start = end
    return found


def digest(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def _staged(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Recipes, and chunks that this task hasn't met before."""
    tokens, met = encoder(path), set()
    end = np.array([END], tokens.dtype)
    width = tokens.dtype.itemsize
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            recipes, sizes, chunks = [], [], {}
            for found in tokens.encode(texts(part.column(1))):
                found = np.append(found, end)
                ids, start, own = found.tobytes(), 0, []
                for stop in cuts(found):
                    chunk = ids[start * width : stop * width]
                    key, start = digest(chunk), stop
                    own.append(key)
                    if key not in met:
                        met.add(key)
                        chunks[key] = chunk
                recipes.append(own)
                sizes.append(start)
            n, m = len(recipes), len(chunks)
            columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(recipes, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], ["doc_id", "n_tokens", "digests", "digest", "ids"])
            yield pa.RecordBatch.from_arrays([*[pa.nulls(m, c.type) for c in columns], pa.array(list(chunks), pa.binary()), pa.array(list(chunks.values()), pa.binary())], ["doc_id", "n_tokens", "digests", "digest", "ids"])


def stored_once(staged: DataFrame) -> DataFrame:
    """``digest, ids`` of every distinct chunk: a chunk that several tasks met stays with the first of them.

    Only digests are shuffled; ids are, too, where the repeats are too many to be broadcast.
    """
    held = staged.filter("digest is not null")
    several = held.groupBy("digest").agg(F.count("*").alias("n"), F.min("task").alias("first")).filter("n > 1").select("digest", "first")
    several = small(stored(several, "token-several"), BROADCAST_ROWS)
    others = stored(held.select("digest", "task").join(several, "digest").filter("task != first").select("digest", "task"), "token-repeats")
    return held.join(small(others, BROADCAST_ROWS), ["digest", "task"], "left_anti").select("digest", "ids")


def merkle(leaves: Iterator[bytes]) -> bytes:
    """The root over leaves in order: pairs are hashed level by level, an odd node goes up as it is."""
    stack: list[tuple[int, bytes]] = []
    for leaf in leaves:
        node = (0, leaf)
        while stack and stack[-1][0] == node[0]:
            node = (node[0] + 1, hashlib.sha256(stack.pop()[1] + node[1]).digest())
        stack.append(node)
    while len(stack) > 1:
        right = stack.pop()[1]
        level, left = stack.pop()
        stack.append((level + 1, hashlib.sha256(left + right).digest()))
    return stack[0][1] if stack else hashlib.sha256(b"").digest()


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part; a part's recipes come in order, in one task."""
    counts: dict[int, list[int]] = {}
    order: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for part, seq, n, leaf in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            total = counts.setdefault(part, [0, 0])
            total[0] += 1
            total[1] += n
            order.setdefault(part, []).append((seq, bytes.fromhex(leaf)))
    for part, leaves in sorted(order.items()):
        leaves.sort()
        root = merkle(leaf for _, leaf in leaves).hex()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([counts[part][0]], pa.int64()), pa.array([counts[part][1]], pa.int64()), pa.array([root])], ["part", "n_docs", "n_tokens", "root"])


def leaves(recipes: DataFrame) -> DataFrame:
    """The recipes with ``leaf``, a hash of doc_id, number of tokens and chunks."""
    hexes = F.array_join(F.transform("digests", F.hex), ",")
    return recipes.withColumn("leaf", F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_tokens").cast("string"), hexes).cast("binary"), 256))


def manifest(recipes: DataFrame) -> DataFrame:
    rows = recipes.select("part", "seq", "n_tokens", "leaf").repartition("part")
    return rows.mapInArrow(_roots, "part bigint, n_docs bigint, n_tokens bigint, root string")


def roots_hold(spark: SparkSession, path: str) -> bool:
    """Whether the recipes still have the roots of the manifest."""
    now, then = manifest(leaves(spark.read.parquet(f"{path}/recipes"))), spark.read.parquet(f"{path}/manifest")
    counted = now.withColumn("d", F.lit(1)).unionByName(then.withColumn("d", F.lit(-1)))
    return counted.groupBy("part", "n_docs", "n_tokens", "root").agg(F.sum("d").alias("d")).filter("d != 0").isEmpty()


def write(docs: DataFrame, tokenizer_path: str, path: str) -> str:
    """Encode all documents and write a store to a new folder; returns the path.

    A null text is empty, so its document is the end id alone. Documents of equal doc_id follow each other,
    null doc_ids come first. Equal documents share all chunks. An empty table gives empty tables.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    staged = docs.select("doc_id", F.col("text")).mapInArrow(lambda b: _staged(b, tokenizer_path), f"doc_id {id_type}, n_tokens bigint, digests array<binary>, digest binary, ids binary")
    staged = stored(staged.withColumn("task", F.spark_partition_id()), "token-staging")
    stored_once(staged).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = staged.filter("digests is not null").select("doc_id", "n_tokens", "digests")
    # rows of one doc_id, or none, may take several ranges
    recipes = recipes.withColumn("_h", F.xxhash64("digests")).withColumn("_i", F.monotonically_increasing_id())
    recipes = recipes.repartitionByRange("doc_id", "_h", "_i").sortWithinPartitions("doc_id", "_h", "_i").drop("_h", "_i")
    recipes = stored(recipes.select(F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("seq"), "*"), "token-recipes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offsets = stored(recipes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "token-offsets")
    ahead = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0))
    recipes = leaves(recipes.join(small(offsets, BROADCAST_ROWS), "part").select("part", "seq", "doc_id", "n_tokens", start.alias("start"), "digests"))
    recipes.write.parquet(f"{path}/recipes")
    spark = docs.sparkSession
    manifest(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    return path


_operators: dict[int, list[int]] = {}


def _times(matrix: list[int], vector: int) -> int:
    total, k = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[k]
        vector >>= 1
        k += 1
    return total


def _zeros(n: int) -> list[int]:
    """The linear map that n zero bytes make of a CRC-32."""
    if n not in _operators:
        if n == 1:
            bit = [0xEDB88320] + [1 << k for k in range(31)]
            byte = bit
            for _ in range(3):
                byte = [_times(byte, x) for x in byte]
            _operators[1] = byte
        else:
            half = _zeros(n // 2)
            whole = [_times(half, x) for x in half]
            _operators[n] = [_times(_zeros(1), x) for x in whole] if n % 2 else whole
    return _operators[n]


def crc_join(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of bytes put together, from the CRC-32 and length of each part."""
    crc = 0
    for other, n in parts:
        crc = _times(_zeros(n), crc) ^ other if n else crc
    return crc


def _checked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """CRC-32 and count of each chunk's ids as 32-bit integers; ids that don't fit their digest are an error."""
    for batch in batches:
        crcs, counts = [], []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest(ids) != key:
                raise ValueError(f"chunk {key.hex()} is damaged")
            wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
            crcs.append(zlib.crc32(wide.tobytes()))
            counts.append(len(wide))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(counts, pa.int64())], ["digest", "crc", "n"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for seq, n, parts in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4)), strict=True):
            if any(p["n"] is None for p in parts) or sum(p["n"] for p in parts) != n:
                raise ValueError(f"recipe {seq} lacks chunks")
            crcs.append(crc_join([(p["crc"], 4 * p["n"]) for p in parts]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crcs, pa.int64())], ["seq", "doc_id", "start", "n_tokens", "ids_crc32"])


def digest_of(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Read a store back: ``doc_id, start, n_tokens, ids_crc32`` of every document.

    The recipes are held against the roots of the manifest first, each stored chunk is read and verified
    once, wherever it is used, and a recipe's number of tokens against its chunks; what doesn't agree is an
    error. The CRC-32 of a document is put together from those of its chunks, so no ids are shuffled.
    """
    if not roots_hold(spark, path):
        raise ValueError("the recipes are not those of the manifest")
    chunks, recipes = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/recipes")
    # as many as there are chunks, so they are never broadcast
    sums = stored(chunks.mapInArrow(lambda b: _checked(b, width), "digest binary, crc bigint, n bigint"), "token-sums").hint("merge")
    used = recipes.select("seq", "doc_id", "start", "n_tokens", F.posexplode("digests").alias("at", "digest")).join(sums, "digest", "left")
    parts = used.groupBy("seq", "doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("at", "crc", "n"))).alias("parts"))
    id_type = recipes.schema["doc_id"].dataType.simpleString()
    return parts.mapInArrow(_joined, f"seq bigint, doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint").drop("seq")


def verified(spark: SparkSession, path: str) -> bool:
    """Whether the recipes still have the roots of the manifest, and every chunk they name is there."""
    named = spark.read.parquet(f"{path}/recipes").select(F.explode("digests").alias("digest"))
    return roots_hold(spark, path) and named.join(spark.read.parquet(f"{path}/chunks"), "digest", "left_anti").isEmpty()


def _ids(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.frombuffer(b"".join(p["ids"] for p in parts), f"<u{width}").astype(np.int32) for parts in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])


def documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """``doc_id, ids`` of every document, put together again from its chunks."""
    chunks, recipes = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/recipes")
    used = recipes.select("seq", "doc_id", F.posexplode("digests").alias("at", "digest")).join(chunks, "digest")
    parts = used.groupBy("seq", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts")).select("doc_id", "parts")
    id_type = recipes.schema["doc_id"].dataType.simpleString()
    return parts.mapInArrow(lambda b: _ids(b, width), f"doc_id {id_type}, ids array<int>")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write a store to the shared folder and return what `digest_of` reads from it."""
    return digest_of(docs.sparkSession, write(docs, tokenizer_path, new_path(docs.sparkSession)), encoder(tokenizer_path).dtype.itemsize)
