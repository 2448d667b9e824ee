"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Words are runs of letters and digits, A-Z in lower case; shingles are five words. A template occurs where at
least 0.8 of its shingles stand in a window. Templates are put into classes by their number of shingles,
doubling, and each class has windows of its own: somewhat longer than its longest template, at a stride of
a quarter of that, so that every place of a template lies whole in some window. From the length of window
and template follows the least Jaccard similarity of the two, and from it the number of bands that makes
the chance of retrieving nothing less than `MISS`. Retrieved templates are verified by counting their
distinct shingles in the window.

Templates go to the tasks with the code, in blocks of `BLOCK_TEMPLATES`; documents are never shuffled unless
there are several blocks, whose matches are then put together.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import vector
from tidebook.llm.common import stored
from tidebook.llm.templates import TEMPLATES
from tidebook.llm.vector import G, mix

SHINGLE = 5
CONTAINED = 0.8
MISS = 1e-6
BLOCK_TEMPLATES = 20_000
MOST_BANDS = 40
G32 = np.uint32(0x9E3779B1)
#: Shingles whose minima are taken at once: few enough for their products to stay in a core's cache.
PIECE = 1 << 15

SEPARATES = np.ones(256, dtype=bool)
SEPARATES[48:58] = SEPARATES[65:91] = SEPARATES[97:123] = SEPARATES[128:] = False


def words(text: bytes) -> np.ndarray:
    return vector.words_of(text, SEPARATES)


def runs(word_hashes: np.ndarray) -> np.ndarray:
    """The hash of each run of five words, in order; of all words if they are fewer, but some."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    size = min(SHINGLE, n)
    h = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = mix(h * G + word_hashes[k : n - size + 1 + k])
    return h


def settings(similarity: float) -> tuple[int, int]:
    """Registers per band and bands: as many registers as a moderate number of bands allows."""
    for rows in (3, 2, 1):
        bands = 1 if similarity > 1 - 1e-9 else math.ceil(math.log(MISS) / math.log(1 - similarity**rows))
        if bands <= MOST_BANDS or rows == 1:
            return rows, bands
    raise AssertionError


class Class:
    """Templates of more than half of `most` shingles, up to `most`."""

    def __init__(self, most: int):
        self.stride = max(1, most // 4)
        self.blocks = -(-(most + self.stride - 1) // self.stride)
        self.most, self.window = most, self.blocks * self.stride
        least = most // 2 + 1
        need = math.ceil(CONTAINED * least - 1e-9)
        # a window holds at least `need` of the template's shingles; the union has the rest of both
        self.rows, self.bands = settings(min(1.0, need / (self.window + least - need)))
        self.factors = [[mix(np.array([band * 8 + row + most * 4096], dtype=np.uint64)).astype(np.uint32)[0] | np.uint32(1) for row in range(self.rows)] for band in range(self.bands)]
        self.tables: list[dict[int, list[str]]] = [defaultdict(list) for _ in range(self.bands)]
        self.maybe = [np.zeros(1 << 16, dtype=bool) for _ in range(self.bands)]

    def keys(self, shingles: np.ndarray, blocks: int) -> Iterator[np.ndarray]:
        """The band keys of all runs of `blocks` neighbouring columns.

        Shingles are hashes already, so an odd factor permutes their low 32 bits well enough.
        """
        for factors in self.factors:
            key = np.zeros(shingles.shape[1] - blocks + 1, dtype=np.uint32)
            for factor in factors:
                least, span = (shingles * factor).min(axis=0), 1
                while span < blocks:
                    step = min(span, blocks - span)
                    least = np.minimum(least[:-step], least[step:])
                    span += step
                key += least
                key *= G32
            yield key

    def add(self, name: str, shingles: np.ndarray) -> None:
        for band, key in enumerate(self.keys(shingles.astype(np.uint32)[:, None], 1)):
            self.tables[band][int(key[0])].append(name)
            self.maybe[band][int(key[0]) >> 16] = True

    def retrieve(self, shingles: np.ndarray) -> set[tuple[int, str]]:
        """Window starts with the templates that share a band with them, of 32-bit shingles of whole windows.

        A window is some blocks of one stride each, and its minimum that of theirs; a block is a column, so that
        minima run along memory.
        """
        found = set()
        lines = np.concatenate([shingles, np.full(-len(shingles) % self.stride, shingles[-1])]).reshape(-1, self.stride)
        size = max(1, PIECE // self.stride)
        for first in range(0, len(lines) - self.blocks + 1, size):
            columns = np.ascontiguousarray(lines[first : first + size + self.blocks - 1].T)
            for band, key in enumerate(self.keys(columns, self.blocks)):
                for at in np.flatnonzero(self.maybe[band][key >> np.uint32(16)]).tolist():
                    for name in self.tables[band].get(int(key[at]), ()):
                        found.add(((first + at) * self.stride, name))
        return found


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.sets: dict[str, np.ndarray] = {}
        self.classes: dict[int, Class] = {}
        for name, text in sorted(templates.items()):
            shingles = np.unique(runs(words(text.encode())))
            if not len(shingles):
                continue
            self.sets[name] = shingles
            most = 1 << (len(shingles) - 1).bit_length()
            self.classes.setdefault(most, Class(most)).add(name, shingles)

    def scan(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, str]]]:
        """For each text (its word hashes), the first and last word of every verified match with the template."""
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        each = [runs(w) for w in texts]
        low = [x.astype(np.uint32) for x in each]
        for c in self.classes.values():
            # texts are put together, apart by more than a window of the class, with shingles that no template has
            gap = np.full(c.window + 1, np.iinfo(np.uint32).max, dtype=np.uint32)
            starts = np.cumsum([0] + [len(x) + len(gap) for x in low])
            row = np.concatenate([part for x in low for part in (x, gap)]) if low else gap
            for at, name in c.retrieve(row):
                owner = int(np.searchsorted(starts, at, "right")) - 1
                own = each[owner]
                lo = at - int(starts[owner])
                window = own[max(0, lo) : lo + c.window]
                if not len(window):  # the window starts in the gap before the next text
                    owner, lo = owner + 1, at - int(starts[owner + 1])
                    if owner >= len(each):
                        continue
                    own = each[owner]
                    window = own[max(0, lo) : max(0, lo + c.window)]
                hit = np.isin(window, self.sets[name])
                if len(np.unique(window[hit])) >= CONTAINED * len(self.sets[name]) - 1e-9:
                    places = np.flatnonzero(hit) + max(0, lo)
                    found[owner].append((int(places[0]), min(int(places[-1]) + SHINGLE, len(texts[owner])) - 1, name))
        return [merged(x) for x in found]


def merged(matches: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Overlapping matches of one template as one, by start, then name."""
    out: list[tuple[int, int, str]] = []
    for first, last, name in sorted(matches, key=lambda m: (m[2], m[0], m[1])):
        if out and out[-1][2] == name and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]), name)
        else:
            out.append((first, last, name))
    return sorted(out, key=lambda m: (m[0], m[2], m[1]))


def _scanned(batches: Iterator[pa.RecordBatch], templates: dict[str, str]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates)
    for batch in batches:
        for first, texts in vector.words_of_each(vector.texts(batch.column(1)), SEPARATES):
            found = scanner.scan(texts)
            names = [sorted({m[2] for m in x}) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(texts)), pa.array([len(x) for x in names], pa.int64()), pa.array([",".join(x) for x in names], pa.string()),
                    pa.array([",".join(f"{name}:{a}:{z}" for a, z, name in x) for x in found], pa.string()),
                ],
                ["doc_id", "n_licenses", "licenses", "spans"],
            )


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per row of `docs`: ``doc_id, n_licenses, licenses, spans``.

    ``licenses`` are the names of the templates that occur, sorted; ``spans`` are ``name:first:last`` with
    word numbers from 0, both inclusive, by place, then name. A null or wordless text has none, and a
    template without words never occurs. Repeated rows get equal results; further columns are ignored.
    Names of templates hold no comma or colon.
    """
    names = sorted(templates)
    blocks = [{n: templates[n] for n in names[at : at + BLOCK_TEMPLATES]} for at in range(0, max(1, len(names)), BLOCK_TEMPLATES)]
    columns = "n_licenses bigint, licenses string, spans string"
    if len(blocks) == 1:
        id_type = docs.schema["doc_id"].dataType.simpleString()
        return docs.select("doc_id", "text").mapInArrow(lambda b: _scanned(b, blocks[0]), f"doc_id {id_type}, {columns}")
    keyed = stored(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "license-docs")
    parts = [keyed.select("row", "text").mapInArrow(lambda b, block=block: _scanned(b, block), f"row bigint, {columns}").filter("n_licenses > 0") for block in blocks]
    every = functools.reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.sum("n_licenses").alias("n"), F.collect_list("licenses").alias("l"), F.collect_list("spans").alias("s"))
    joined = lambda lists: F.split(F.array_join(lists, ","), ",")
    part = lambda s: F.split(s, ":")
    by_place = F.array_sort(F.transform(joined(F.col("s")), lambda s: F.struct(part(s)[1].cast("long").alias("a"), part(s)[0].alias("name"), part(s)[2].cast("long").alias("z"), s.alias("s"))))
    found = keyed.select("row", "doc_id").join(every, "row", "left")
    return found.select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join(F.array_sort(joined(F.col("l"))), ","), F.lit("")).alias("licenses"),
        F.coalesce(F.array_join(F.transform(by_place, lambda x: x["s"]), ","), F.lit("")).alias("spans"),
    )
