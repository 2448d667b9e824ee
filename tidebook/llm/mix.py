"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree (DataFrame functions only).

1. Targets. Sources, by code point with null last, weigh 1, 2, 3, repeating, and share all words of the
   corpus; no source's target exceeds `MOST` times its own words, and the excess is shared again by weight.
   This is a water level: ``target = least(MOST * size, level * weight)``.
2. Blocks. Documents of a source are dealt by a seeded hash into blocks of some `BLOCK_DOCS` documents, so
   a block is a random, disjoint part of its source however large that is. A block is drawn once for each
   whole time that the target holds the source, and once more if it is among the first blocks, in block
   order, whose words fill the rest of the target. The block that the target ends in is drawn in part:
   whole documents, in permuted order, as long as they fit; documents longer than the rest are passed over.
   Rounds go on from there until no document's coming or going brings a source nearer to its target: what
   is left is filled by those that fit twice, in the same order; if there is none, the nearest one comes.
   Above the target documents go by the same rule. Documents are never cut. This gives each source its block
   quota: how many blocks, counted as often as they are drawn, its target takes.
3. Splitting tree. The root holds the block quotas of all sources and all output shards. A node gives its left
   child half of its blocks, of exact number: given the quotas of the sources in the node, those that go left
   follow the multivariate hypergeometric law. The leaves are the shards; quotas add up exactly on every level.
4. Drawing. The blocks of a source are permuted, and each shard in turn takes as many as its quota says: draws
   are disjoint, and what no quota takes isn't in the mix. ``taken`` counts these draws.
5. In a shard, documents are ordered by a hash: a local shuffle.

All sums over documents are made by block first. Prefix sums run over a bounded range of the blocks of a source
and the documents of a block, never over all of a source in one task. Rows equal in all that counts are numbered,
so that they are dealt into blocks like others.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import NON_WHITE, small, stored

MOST = 3
CYCLE = 3
BLOCK_DOCS = 256
SEED = 20240611
BROADCAST_SOURCES = 100_000
#: Rows up to which the plan of copies (some 50 bytes a row) is broadcast to the documents.
BROADCAST_PLAN = 300_000
#: Blocks of a source that a task sums up one by one.
RANGE = 4096
#: Drawn blocks per output shard, at most; the tree has as many levels as that takes.
SHARD_BLOCKS = 16


def running(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the group before this one; `order` counts from 0, one row each.

    Ranges of `RANGE` rows are summed first, so a window holds no more than that, or one row a range.
    """
    df = df.withColumn("_range", F.floor(F.col(order) / RANGE))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    sums = sums.select(group, "_range", F.coalesce(F.sum("_sum").over(upto(group).orderBy("_range")), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(upto(group, "_range").orderBy(order)), F.lit(0))
    return df.withColumn(name, inside).join(sums, [group, "_range"]).withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def keyed(docs: DataFrame) -> tuple[Column, Column]:
    """The words of a text, and the key of a row: rows of one key are equal in doc_id, source and text."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(NON_WHITE)).cast("long")
    return size, F.xxhash64(F.lit(SEED), "doc_id", "source", "text")


def numbered(rows: DataFrame, key: str = "key") -> DataFrame:
    """The rows with ``number``: 0, 1, ... among rows of one key.

    Rows that have no equals, nearly all, aren't moved. Equals are numbered in each of their tasks apart and
    shifted by the counts of the tasks before, so a row that a third of the table repeats makes no large task.
    """
    several = small(stored(rows.groupBy(key).count().filter("count > 1").select(key), "mix-equals"), BROADCAST_PLAN)
    alone = rows.join(several, key, "left_anti").withColumn("number", F.lit(0).cast("long"))
    if several.isEmpty():
        return alone
    part = stored(rows.withColumn("_part", F.spark_partition_id()).join(several, key, "left_semi"), "mix-equal-rows")
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = part.groupBy(key, "_part").count().select(key, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(key, "_part").orderBy(key)) - 1
    equal = part.withColumn("number", place).join(counts, [key, "_part"]).withColumn("number", (F.col("number") + F.col("_before")).cast("long"))
    return alone.unionByName(equal.drop("_part", "_before"))


def sized(docs: DataFrame) -> DataFrame:
    """``row, doc_id, source, size, same, number, key``, stored: the words and the permutation key of every row.

    Rows equal in doc_id, source and text are interchangeable, so reruns agree whatever order ties take.
    """
    size, same = keyed(docs)
    df = docs.select("doc_id", "source", size.alias("size"), same.alias("same")).withColumn("row", F.monotonically_increasing_id())
    df = numbered(stored(df, "mix-words"), "same")
    return stored(df.withColumn("key", F.xxhash64(F.lit(SEED), "same", "number")), "mix-sizes")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """``sid, source, n_docs, source_size, weight, target`` for each source; stored, one row per source.

    The water level is found in closed form: with sources in the order of the level that fills them,
    ``most * size / weight``, those below the level are full and the others share what is left by weight.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    sources = stored(sources.withColumn("sid", F.row_number().over(rank)), "mix-sources").withColumn("weight", (F.col("sid") - 1) % CYCLE + 1)
    full_at = most * F.col("source_size") / F.col("weight")
    before = Window.orderBy("full_at", "sid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    df = sources.withColumn("full_at", full_at)
    df = df.withColumn("total", F.sum("source_size").over(everything)).withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    df = df.withColumn("level", (F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.col("rest_weight"))
    # the first source in that order which the level doesn't fill sets it; if all are full none does
    level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "sid", "level"))).over(everything)["level"]
    df = df.withColumn("level", level).withColumn("target", F.least(most * F.col("source_size").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(float("inf")))))
    return stored(df.select("sid", "source", "source_size", "n_docs", "weight", "target"), "mix-targets")


def flipped(near: DataFrame, gaps: DataFrame, share: int) -> DataFrame:
    """One round: `near` with ``gap, flip``, where ``flip`` says that the document comes (or, above the target, goes).

    In the order of blocks and keys these are the first documents, none longer than the gap by `share`, that
    the gap holds; where no document is that short, the one that leaves the least of the gap (after the first
    round also where one leaves nothing). `near` has all
    documents in the first round (`share` 1); in later ones those that can't bring their source nearer are left out.
    From the second round on, two rounds at least halve a gap, or leave nothing that fits into it.
    """
    rest = F.abs("gap")
    if share == 1:
        df = near.join(gaps, "sid", "left")
    else:
        df = near.join(gaps, "sid").filter(F.col("size") < 2 * rest)
    side = F.coalesce(F.col("extra") == (F.col("gap") < 0), F.lit(False))
    df = df.withColumn("may", side & (F.col("size") > 0) & (F.col("size") < 2 * rest))
    # documents without words are drawn along with their block
    df = df.withColumn("fits", side & (F.col("size") * share <= rest) & ((F.col("size") > 0) | F.lit(share == 1)))
    sums = df.filter("fits").groupBy("sid", "block").agg(F.sum("size").alias("words"))
    sums = running(sums, "sid", "block", "words", "before").select("sid", "block", "before")
    sums = small(stored(sums, "mix-block-sums"), BROADCAST_SOURCES)
    nearest = F.min(F.when(F.col("may"), F.struct(F.abs(rest - F.col("size")).alias("off"), "size", "key", "row")))
    one = df.groupBy("sid").agg(F.max(F.col("fits") & F.col("may")).alias("any"), nearest.alias("nearest"))
    # a document that fills the gap to the word ends the rounds sooner
    one = one.filter(~F.col("any") | F.lit(share > 1) & (F.col("nearest.off") == 0)).select("sid", F.col("nearest.row").alias("nearest")).filter("nearest is not null")
    one = small(stored(one, "mix-nearest"), BROADCAST_SOURCES)
    in_block = Window.partitionBy("sid", "block").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(in_block)
    df = df.join(sums, ["sid", "block"], "left").withColumn("upto", upto).join(one, "sid", "left")
    prefix = F.col("fits") & F.coalesce(F.col("upto") <= rest, F.lit(False))
    flip = F.when(F.col("nearest").isNull() | (F.col("size") == 0), prefix).otherwise(F.col("row") == F.col("nearest"))
    return df.withColumn("flip", flip).drop("may", "fits", "before", "upto", "nearest")


def drawn(sizes: DataFrame, by_source: DataFrame) -> DataFrame:
    """``row, doc_id, source, sid, block, size, same, number, source_size, target, copies``: how often the mix takes each row."""
    sources = small(by_source, BROADCAST_SOURCES)
    n_blocks = F.ceil(F.col("n_docs") / BLOCK_DOCS)
    df = sizes.join(sources.withColumnRenamed("source", "name"), sizes["source"].eqNullSafe(F.col("name")))
    df = df.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED + 1), "key"), n_blocks))
    df = df.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    df = stored(df.withColumn("quota", F.round(F.col("target") - F.col("times") * F.col("source_size")).cast("long")).drop("name", "n_docs", "weight"), "mix-blocks")
    gaps = df.filter("quota > 0").groupBy("sid").agg(F.first("quota").alias("gap"))
    near, first, flips, share = df.withColumn("extra", F.lit(False)), None, [], 1
    while True:
        gaps = small(stored(gaps, "mix-gaps"), BROADCAST_SOURCES)
        if first is not None and gaps.isEmpty():
            break
        moved = stored(flipped(near, gaps, share), "mix-moved")
        got = F.sum(F.when(F.col("flip"), F.col("size")).otherwise(0))
        gaps = moved.groupBy("sid", "gap").agg(got.alias("got")).filter("got > 0")
        gaps = gaps.select("sid", (F.col("gap") - F.signum("gap").cast("long") * F.col("got")).alias("gap")).filter("gap != 0")
        if first is None:
            first = moved.withColumn("extra", F.col("flip"))
        else:
            flips.append(moved.filter("flip").select("row"))
        # gaps only shrink, so a document of twice the gap or more is settled
        near = moved.withColumn("extra", F.col("extra") != F.col("flip")).drop("gap", "flip")
        share = 2
    df = first
    if flips:
        odd = stored(functools.reduce(DataFrame.unionByName, flips).groupBy("row").count().filter("count % 2 = 1").select("row", F.lit(True).alias("odd")), "mix-flips")
        df = df.join(small(odd, BROADCAST_PLAN), "row", "left").withColumn("extra", F.col("extra") != F.coalesce("odd", F.lit(False)))
    return df.select("row", "doc_id", "source", "sid", "block", "size", "same", "number", "source_size", "target", (F.col("times") + F.col("extra").cast("int")).alias("copies"))


def ranked(rows: DataFrame, group: str, by: Column, ties: list[str], name: str) -> DataFrame:
    """Adds `name`: the row's number, from 1, in the hash order `by` of its group.

    Ranks are taken in ranges of the hash and shifted by the counts of the ranges before, so that no task has all
    rows of a group.
    """
    rows = rows.withColumn("_u", by).withColumn("_range", F.shiftright("_u", 56))
    counts = rows.groupBy(group, "_range").count()
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(group, "_range").orderBy("_u", *ties))
    return rows.withColumn(name, rank).join(counts, [group, "_range"]).withColumn(name, F.col(name) + F.col("_before")).drop("_u", "_range", "_before")


def split(slots: DataFrame, levels: int) -> DataFrame:
    """Stored: ``shard, sid, quota`` of the leaves of a tree of so many levels.

    The root's quota of a source is its number of rows ``sid, slot``, which stand for any of its blocks. On each
    level the slots of a node are ranked by a hash of their own; the first half (rounded up on even nodes, down
    on odd ones) goes left. So the counts of the sources that go left are hypergeometric, and every quota is exact.
    """
    slots = slots.select("sid", "slot", F.lit(0).cast("long").alias("shard"))
    for level in range(levels):
        rows = ranked(slots, "shard", F.xxhash64(F.lit(SEED + 2 + level), "sid", "slot"), ["sid", "slot"], "rank")
        counts = slots.groupBy("shard").agg(F.count("*").alias("n"))
        left = F.floor((F.col("n") + (F.col("shard") + 1) % 2) / 2)
        slots = rows.join(counts, "shard").withColumn("shard", F.col("shard") * 2 + (F.col("rank") > left).cast("int")).select("sid", "slot", "shard")
        slots = stored(slots, "mix-tree")
    return stored(slots.groupBy("shard", "sid").agg(F.count("*").alias("quota")), "mix-leaves")


def depth(n_units: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n_units) / SHARD_BLOCKS)))


def blocks_drawn(permuted: DataFrame, leaves: DataFrame) -> DataFrame:
    """``sid, block, copy, shard``: the blocks of each source, by their ``turn``, as the quotas of the shards take them."""
    upto = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    turns = leaves.withColumn("after", F.coalesce(F.sum("quota").over(upto), F.lit(0)))
    taken = turns.select("sid", "shard", F.explode(F.sequence(F.col("after") + 1, F.col("after") + F.col("quota"))).alias("turn"))
    return permuted.join(taken, ["sid", "turn"]).select("sid", "block", "copy", "shard")


def shards(draws: DataFrame, levels: int | None = None) -> DataFrame:
    """``sid, block, copy, shard``: the shard of each drawn block. `draws` is what `drawn` returns."""
    most = draws.groupBy("sid", "block").agg(F.max("copies").alias("copies")).filter("copies > 0")
    units = most.select("sid", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    permuted = stored(ranked(units, "sid", F.xxhash64(F.lit(SEED + 1000), "sid", "block", "copy"), ["block", "copy"], "turn"), "mix-units")
    leaves = split(permuted.select("sid", F.col("turn").alias("slot")), depth(permuted.count()) if levels is None else levels)
    return blocks_drawn(permuted, leaves)


def placed(docs: DataFrame, levels: int | None = None) -> DataFrame:
    """What `mix` returns, with ``same`` and ``number``."""
    sizes = sized(docs)
    draws = stored(drawn(sizes, targets(sizes)), "mix-draws")
    # a block is drawn a few times at most: `MOST`, and once more by its own documents' coming
    at = shards(draws, levels).groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("at"))
    df = draws.join(small(stored(at, "mix-places"), BROADCAST_SOURCES), ["sid", "block"], "left")
    places = F.transform(F.filter("at", lambda x: x["copy"] <= F.col("copies")), lambda x: x["shard"])
    df = df.withColumn("shards", F.coalesce(places, F.array().cast("array<bigint>"))).withColumn("copies", F.size("shards"))
    return df.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", "shards", "row", "same", "number")


def mix(docs: DataFrame, levels: int | None = None) -> DataFrame:
    """One row per row of `docs`: ``doc_id, size, source_size, target, taken, source, copies, shards, row``.

    ``taken`` is copies times size, ``shards`` the output shards of the copies. A null text has size 0; a
    source whose words are all 0 has target 0; null is a source of its own, the last. Empty tables give no
    rows. Further columns are ignored; repeated rows are drawn one by one.
    """
    return placed(docs, levels).drop("same", "number")


def mixed_documents(docs: DataFrame, levels: int | None = None) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, shard by shard and shuffled inside a shard.

    Columns are those of `docs`. Repeated rows deal the copies out among themselves by their numbers.
    """
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    mixed = stored(placed(docs, levels).filter(F.size("shards") > 0).select("same", "number", "shards"), "mix-taken")
    n_shards = 1 + (mixed.agg(F.max(F.array_max("shards"))).first()[0] or 0)
    _, same = keyed(docs)
    rows = docs.select(same.alias("same"), *[F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)])
    spread = numbered(rows, "same").join(small(mixed, BROADCAST_PLAN), ["same", "number"]).withColumn("shard", F.explode("shards"))
    spread = spread.withColumn("place", F.xxhash64(F.lit(SEED + 99), "same", "number", "shard"))
    return spread.repartition(n_shards, "shard").sortWithinPartitions("shard", "place").select(*own).toDF(*names)
