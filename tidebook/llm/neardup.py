"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. One pass of Python hashes each text into its shingle set, the set's 128-bit digest, and band keys.
   Documents with equal sets form a class; from here on a class is one node, however many copies it has.
2. Every bucket (band key) of two or more classes gets a leader: the class that meets most others in all of
   its buckets, which in a group of altered copies is the least altered one. Each class is paired with the
   foremost of the leaders of its buckets: one pair a class.
3. Pairs are confirmed on full sets, and components are formed: union-find inside each partition, then
   large-star and small-star joins until only stars are left.
4. Two classes that share a bucket but not a component may still be linked. Classes that are joined by buckets
   of several components are a group. In each group a class is written as what it differs in from the group's
   typical set, the shingles that most of its classes have. What sizes alone link is linked through the class
   that differs least. All other links need common differences: a prefix filter over these, those of one
   component first, then the rarest, finds the pairs, by two or four shingles at once where so many are needed. Neither what
   all have in common nor what only one has makes pairs, and no link between classes of a common bucket is lost.
5. While a group promises many more pairs than classes, a round pairs each of its classes with one leader of
   its keys instead, and components grow; the pairs that are left after that are all compared.

With 64 bands of 7 registers, a pair of similarity 0.8 has no common bucket with a probability below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm import vector
from tidebook.llm.common import small, stored

BANDS, ROWS, REGISTERS = 64, 7, 449
BROADCAST_ROWS = 300_000
#: Least similarity of a link, in hundredths.
SIMILAR = 80
#: Pairs a class, before sizes and places are looked at, from which on a round of leaders comes first.
MANY_PAIRS = 64
#: Nodes that a task's union-find holds at once.
FOREST_NODES = 1_000_000
#: Parts that the rows of a group are dealt into where they meet the group's typical set.
SALTS = 16
#: So many shingles at once may be a key, if no more than so many places of a class come into question; else keys get too many.
LEVELS = {2: 12, 4: 10}
KEY, OTHER = ["grp", "ell", "token"], ["cid", "d", "w", "place", "level", "component"]
#: Whether sizes alone link a class with its group's nearest one.
NEAR = f"w + least <= {100 - SIMILAR} * l"


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, all_texts = batch.column(0), batch.column(1), vector.texts(batch.column(2))
        for first, words in vector.words_of_each(all_texts):
            sets = [vector.shingles(w, size) for w in words]
            keys = vector.band_keys(vector.super_minhash(sets, REGISTERS), BANDS, ROWS)
            filled = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, len(sets)), hashes.slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if f else None for s, f in zip(sets, filled, strict=True)], pa.binary()),
                    pa.array([k if f else None for k, f in zip(keys, filled, strict=True)], pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "n_shingles", "node", "bands"],
            )


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Stored: ``doc_id, text_hash, n_shingles, node, bands``; node and bands are null for an empty set."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text"))
    return stored(rows.mapInArrow(lambda b: _signed(b, size), f"doc_id {id_type}, text_hash bigint, n_shingles bigint, node binary, bands array<bigint>"), "minhash")


def classes(signed: DataFrame) -> DataFrame:
    """Stored: one row per distinct set, ``cid, node, n_shingles, doc_id, text_hash, bands``; the ids are of one member."""
    one = signed.filter("node is not null").groupBy("node").agg(F.first(F.struct("doc_id", "text_hash", "n_shingles", "bands")).alias("m"))
    return stored(one.select("node", "m.*").withColumn("cid", F.monotonically_increasing_id()), "minhash-classes")


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, words in vector.words_of_each(vector.texts(batch.column(1))):
            rows = pa.array([vector.shingles(w, size).view(np.int64) for w in words], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(words)), rows], ["cid", "shingles"])


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Stored: ``cid, shingles`` of the wanted classes, each from the text of one member."""
    keys = small(stored(wanted.select("cid", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "minhash-wanted"), BROADCAST_ROWS)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    rows = rows.join(keys, rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).select("cid", "text")
    sets = rows.mapInArrow(lambda b: _sets(b, size), "cid bigint, shingles array<bigint>")
    return stored(sets.dropDuplicates(["cid"]), "minhash-sets")  # repeated rows give a class its set twice


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Stored: ``a, b, common, total`` of the pairs: sizes of intersection and union of their full sets."""
    side = lambda x: sets.select(F.col("cid").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return stored(both.select("a", "b", "common", (F.size("sa") + F.size("sb") - F.col("common")).alias("total")), "minhash-compared")


def linked(compared: DataFrame) -> DataFrame:
    return compared.filter(100 * F.col("common") >= SIMILAR * F.col("total")).select("a", "b")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a task: each node with the smallest node of its tree. Large tasks yield several forests."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def trees() -> pa.RecordBatch:
        found = [(x, root(x)) for x in list(parent) if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > FOREST_NODES:
            yield trees()
            parent.clear()
    yield trees()


def stars(links: DataFrame) -> bool:
    """Whether the links ``a, b`` are stars: no node is a leaf twice, and no leaf is a centre. Then each star is a component."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")), F.struct(F.col("b").alias("id"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))).alias("x")).select("x.*")
    roles = ends.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return roles.filter((F.col("leaf") > 1) | ((F.col("leaf") > 0) & (F.col("centre") > 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Stored: ``cid, component`` of all nodes with links; the component is its smallest node.

    Each task's links become a forest, then so many tasks' forests together as have some `FOREST_NODES` links in all.
    Trees that are still in several tasks are joined by large and small stars.
    """
    links = stored(links.mapInArrow(_forest, "a bigint, b bigint"), "links")
    links = links.coalesce(1 + links.count() // FOREST_NODES)
    links = stored(links.mapInArrow(_forest, "a bigint, b bigint"), "links-merged")
    while not stars(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "links-least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = stored(large, "links-large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "links-least")
        small_star = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        links = stored(small_star.select("x.*").filter("a != b").distinct(), "links-small")
    roots = links.select(F.col("b").alias("cid"), F.col("b").alias("component")).distinct()
    return stored(links.select(F.col("a").alias("cid"), F.col("b").alias("component")).unionByName(roots), "components")


def led(buckets: DataFrame) -> DataFrame:
    """Stored: ``key, cid, top`` of the buckets of several classes; ``top`` is the leader's ``(score, cid)``."""
    several = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(buckets.join(several, "key"), "minhash-members")
    members = stored(members.join(members.groupBy("cid").agg(F.sum("n").alias("score")), "cid").select("key", "cid", "score"), "minhash-scored")
    leaders = members.groupBy("key").agg(F.max(F.struct("score", "cid")).alias("top"))
    return stored(members.join(leaders, "key"), "minhash-led")


def fitting(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored: ``a, b`` of the pairs ``leader, cid`` of two classes whose sizes allow a link."""
    size = lambda x, n: nodes.select(F.col("cid").alias(x), F.col("n_shingles").alias(n))
    both = pairs.filter("cid != leader").select(F.col("leader").alias("a"), F.col("cid").alias("b")).join(size("a", "n1"), "a").join(size("b", "n2"), "b")
    return stored(both.filter(100 * F.least("n1", "n2") >= SIMILAR * F.greatest("n1", "n2")).select("a", "b"), "minhash-pairs")


def with_component(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))


def mixed(rows: DataFrame, *key: str) -> DataFrame:
    """The rows, which have a component, whose key several components have."""
    several = rows.groupBy(*key).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select(*key)
    return rows.join(several, list(key), "left_semi")


def deltas(sets: DataFrame, info: DataFrame) -> DataFrame:
    """Stored: ``grp, cid, component, score, l, d, w, delta``: a class as what it lacks of its group's typical set, and adds to it.

    The typical set has the shingles that more than half of the group's classes have, `l` of them. With `r` of them
    lacking and `p` others, two classes have ``l - r1 - r2 + o`` shingles in common, `o` being the common part of their
    deltas; so they are linked just if ``(100 + SIMILAR) * o >= w1 + w2 - (100 - SIMILAR) * l``, where ``w`` is
    ``100 * r + SIMILAR * p``. A group without typical shingles has whole sets as deltas.
    """
    sizes = stored(info.groupBy("grp").agg(F.count("*").alias("of")), "minhash-group-sizes")
    counted = sets.join(info, "cid").select("grp", F.explode("shingles").alias("token")).groupBy("grp", "token").agg(F.count("*").alias("f"))
    # the classes have at most twice their mean size of these
    typical = counted.join(small(sizes, BROADCAST_ROWS), "grp").filter("2 * f > of").groupBy("grp").agg(F.collect_list("token").alias("typical"))
    typical = stored(typical, "minhash-typical").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = sets.join(info, "cid").withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int")).join(typical, ["grp", "salt"], "left")
    rows = rows.withColumn("typical", F.coalesce("typical", F.array().cast("array<bigint>")))
    rows = rows.withColumn("lacks", F.array_except("typical", "shingles")).withColumn("adds", F.array_except("shingles", "typical"))
    weight = 100 * F.size("lacks").cast("long") + SIMILAR * F.size("adds")
    return stored(rows.select("grp", "cid", "component", "score", F.size("typical").alias("l"), (F.size("lacks") + F.size("adds")).alias("d"), weight.alias("w"), F.concat("lacks", "adds").alias("delta")), "minhash-deltas")


def bounds(rows: DataFrame) -> DataFrame:
    """Stored: ``grp, least, top, outer`` of the deltas: the group's least `w` and its class, and the least `w` of those too far from it.

    Whatever two sizes link on their own, they link with this class too.
    """
    tops = stored(rows.groupBy("grp").agg(F.min(F.struct("w", "cid")).alias("top")).select("grp", F.col("top.w").alias("least"), F.col("top.cid").alias("top")), "minhash-tops")
    outer = rows.join(small(tops, BROADCAST_ROWS), "grp").filter(f"not ({NEAR})").groupBy("grp").agg(F.min("w").alias("outer"))
    return stored(tops.join(outer, "grp", "left"), "minhash-bounds")


def prefixes(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Stored: ``grp, ell, token, cid, d, w, l, place, level, score``: by what classes of different components can meet.

    Two classes that sizes alone don't link need common shingles in their deltas, and `limits` say how many at least
    (`need`); a far class's partner is far itself, which the common ones must make up for. A class's order of these is: those that no other component of the group has, then the others by the number of
    deltas that have them. The first common one has `need` at and behind it, the second one less, and so on. So a class
    has keys of one shingle and, up to its ``level``, of `ell` shingles at once, and a pair meets by keys of the lower of
    its two levels. ``place`` counts what stands before a key's last shingle, less the others of the key.
    """
    far = rows.join(small(limits, BROADCAST_ROWS), "grp").filter("outer is not null")
    over = F.col("w") - (100 - SIMILAR) * F.col("l")
    need = F.ceil((over + F.when(F.expr(NEAR), F.col("outer")).otherwise(F.col("least"))) / (100 + SIMILAR))
    # what has `o` of these too has a `w` of `SIMILAR * o` at least
    need = F.greatest(need, F.ceil(over / 100)).cast("int")
    far = far.withColumn("need", F.greatest(need, F.lit(1))).filter("d >= need")
    tokens = far.select("grp", "component", "cid", "d", "w", "l", "need", "score", F.explode("delta").alias("token"))
    shared = tokens.groupBy("grp", "token").agg(F.count("*").alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("grp", "token", "f")
    own = tokens.drop("component").join(stored(shared, "minhash-shared"), ["grp", "token"])
    own = own.groupBy("grp", "cid", "d", "w", "l", "need", "score").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("tokens"))
    own = own.withColumn("skip", F.col("d") - F.size("tokens")).withColumn("first", F.size("tokens") - F.col("need") + 1).filter("first > 0")
    level = F.lit(1)
    for ell, places in sorted(LEVELS.items()):
        level = F.when((F.col("need") >= ell) & (F.col("first") + ell - 1 <= places), ell).otherwise(level)
    own = own.withColumn("level", level)
    token = lambda i: F.element_at("tokens", i + 1)["token"]
    none = F.array().cast("array<struct<ell:int,token:bigint,place:int>>")

    def keys(ell: int, chosen: tuple[Column, ...] = (), after: Column | None = None) -> Column:
        """The keys of `ell` shingles, in order, that begin with the chosen ones."""
        last = F.col("first") - 1 + len(chosen)
        start = F.lit(0) if after is None else after + 1
        places = F.sequence(start, last) if after is None else F.when(start <= last, F.sequence(start, last)).otherwise(F.array().cast("array<int>"))
        if len(chosen) < ell - 1:
            return F.flatten(F.transform(places, lambda i: keys(ell, (*chosen, token(i)), i)))
        value = lambda i: F.xxhash64(*chosen, token(i)) if chosen else token(i)
        return F.transform(places, lambda i: F.struct(F.lit(ell).alias("ell"), value(i).alias("token"), (F.col("skip") + i - len(chosen)).cast("int").alias("place")))

    every = F.concat(keys(1), *[F.when(F.col("level") >= ell, keys(ell)).otherwise(none) for ell in sorted(LEVELS)])
    return stored(own.select("grp", "cid", "d", "w", "l", "score", "level", F.explode(every).alias("x")).select("grp", "x.*", "cid", "d", "w", "l", "score", "level"), "minhash-prefixes")


def may_link() -> Column:
    """Whether two prefix rows of a key, of different components, leave enough shingles behind it for a link."""
    most = F.least(F.col("d") - F.col("place"), F.col("d2") - F.col("place2"))
    return ((100 + SIMILAR) * most >= F.col("w") + F.col("w2") - (100 - SIMILAR) * F.col("l")) & (F.col("component") != F.col("component2"))


def met(rows: DataFrame) -> DataFrame:
    """``a, b`` of all pairs of classes that meet by a key and may be linked; a < b."""
    other = rows.select(*KEY, *[F.col(c).alias(f"{c}2") for c in OTHER])
    pairs = rows.filter("level = ell").join(other, KEY).filter(may_link())
    return pairs.select(F.least("cid", "cid2").alias("a"), F.greatest("cid", "cid2").alias("b")).distinct()


def led_pairs(rows: DataFrame) -> DataFrame:
    """``a, b``: each class with the foremost leader of its keys, if it may be linked with one."""
    leaders = rows.groupBy(*KEY).agg(F.max(F.struct("score", *OTHER)).alias("top")).select(*KEY, F.col("top.score").alias("score2"), *[F.col(f"top.{c}").alias(f"{c}2") for c in OTHER])
    pairs = rows.join(leaders, KEY).filter(may_link())
    return pairs.groupBy("cid").agg(F.max(F.struct("score2", "cid2")).alias("top")).select(F.least("cid", "top.cid2").alias("a"), F.greatest("cid", "top.cid2").alias("b")).distinct()


def crowded(rows: DataFrame) -> bool:
    """Whether the pairs of different components that meet by a key are more than `MANY_PAIRS` a class."""
    apart = (F.col("level") > F.col("ell")).cast("double")  # these meet each other by longer keys
    per = rows.groupBy(*KEY, "component").agg(F.count("*").cast("double").alias("c"), F.sum(apart).alias("p"))
    pairs = lambda x: (F.sum(x) * F.sum(x) - F.sum(F.col(x) * F.col(x))) / 2
    found = per.groupBy(*KEY).agg((pairs("c") - pairs("p")).alias("pairs")).agg(F.sum("pairs")).first()[0] or 0
    return found > MANY_PAIRS * rows.select("cid").distinct().count()


def linked_by_deltas(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored: ``a, b, linked`` of pairs of a group: the exact condition, from what the two differ in from the typical set."""
    side = lambda x: rows.select(F.col("cid").alias(x), F.col("delta").alias(f"s{x}"), F.col("w").alias(f"w{x}"), *["l"] * (x == "a"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    holds = (100 + SIMILAR) * F.size(F.array_intersect("sa", "sb")) >= F.col("wa") + F.col("wb") - (100 - SIMILAR) * F.col("l")
    return stored(both.select("a", "b", holds.alias("linked")), "minhash-compared")


def rest_linked(docs: DataFrame, members: DataFrame, nodes: DataFrame, links: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """The components, with the links between classes of a bucket that have not met yet."""
    open_ = stored(mixed(with_component(members, labels), "key").select("cid", F.col("top.cid").alias("leader"), "component", "score").distinct(), "minhash-mixed")
    if open_.isEmpty():
        return labels
    groups = components(open_.filter("cid != leader").select(F.greatest("cid", "leader").alias("a"), F.least("cid", "leader").alias("b")).distinct())
    info = open_.select("cid", "component", "score").distinct().join(groups.withColumnRenamed("component", "grp"), "cid")
    info = stored(info, "minhash-groups-of")
    differ = deltas(full_sets(docs, nodes.join(info, "cid", "left_semi"), size), info)
    limits = bounds(differ)
    links = links.unionByName(differ.join(small(limits, BROADCAST_ROWS), "grp").filter(F.expr(NEAR) & (F.col("cid") != F.col("top"))).select(F.col("cid").alias("a"), F.col("top").alias("b")))
    labels = components(links)
    found, seen = prefixes(with_component(differ.drop("component"), labels), limits), None
    while True:
        rows = stored(mixed(with_component(found, labels), *KEY), "minhash-rows-open")
        if rows.isEmpty():
            return labels
        last = not crowded(rows)
        while True:
            pairs = met(rows) if last else led_pairs(rows)
            if seen is not None:
                pairs = pairs.join(seen, ["a", "b"], "left_anti")
            compared = linked_by_deltas(stored(pairs, "minhash-met"), differ)
            seen = compared.select("a", "b") if seen is None else seen.unionByName(compared.select("a", "b"))
            fresh = compared.filter("linked").select("a", "b")
            if last or not fresh.isEmpty():
                break
            last = True  # leaders have found nothing more
        links = links.unionByName(fresh)
        labels = components(links)
        if last:
            return labels


def labelled(docs: DataFrame, size: int) -> DataFrame:
    """Stored: ``doc_id, text_hash, n_shingles, component`` of every row; the component is null for an empty set."""
    signed = signatures(docs, size)
    nodes = classes(signed)
    members = led(nodes.select("cid", F.explode("bands").alias("key")))
    first = fitting(members.groupBy("cid").agg(F.max("top").alias("top")).select("cid", F.col("top.cid").alias("leader")), nodes)
    ends = first.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    links = linked(confirmed(first, full_sets(docs, nodes.join(ends, "cid", "left_semi"), size)))
    labels = rest_linked(docs, members, nodes, links, components(links), size)
    named = nodes.select("node", "cid").join(labels, "cid", "left").select("node", F.coalesce("component", "cid").alias("component"))
    rows = signed.select("doc_id", "text_hash", "n_shingles", "node").join(named, "node", "left")
    return stored(rows.select("doc_id", "text_hash", "n_shingles", "component"), "minhash-rows")


def grouped(docs: DataFrame, size: int = 2) -> DataFrame:
    """One row per row of `docs`: ``doc_id, n_shingles, component_id, kept, component``.

    Documents are linked if the Jaccard similarity of their sets of `size`-word shingles is at least 0.8.
    ``component_id`` is the smallest doc_id of the component, ``kept`` says that it is the row's own;
    ``component`` numbers the components. A text without words, or null, has an empty set, is linked with
    nothing and kept. A null doc_id has component_id null only if its whole component has; it is then kept
    by none of its rows. Repeated rows are copies of each other. Further columns are ignored.
    """
    rows = labelled(docs, size)
    firsts = stored(rows.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("first")), "minhash-firsts")
    found = rows.join(firsts, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("first")))
    kept = F.col("component").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "component")


def deduplicated(docs: DataFrame, size: int = 5) -> DataFrame:
    """The documents without near copies, with their own columns: of every component one row stays.

    It is the row of smallest doc_id, null last, and of these the one whose text hashes lowest; of rows equal in
    doc_id and text one stays. Texts without words are all kept.
    """
    rows = labelled(docs, size).filter("component is not null")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")
    groups = stored(rows.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1"), "minhash-groups")
    members = rows.join(groups.select("component", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")), "component")
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    members = stored(members.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), stays.alias("stays")).agg(F.count("*").alias("n")), "minhash-members-kept")
    dropped, repeats = members.filter("not stays"), members.filter("stays and n > 1")
    same = lambda d, m: d["doc_id"].eqNullSafe(m["_id"]) & (F.xxhash64(d["text"]) == m["_hash"])
    dropped = small(dropped, BROADCAST_ROWS)
    rest = docs.join(dropped, same(docs, dropped), "left_anti")
    if repeats.isEmpty():
        return rest
    repeats = small(repeats, BROADCAST_ROWS)
    twice = rest.join(repeats, same(rest, repeats), "left_semi")
    return rest.join(repeats, same(rest, repeats), "left_anti").unionByName(twice.dropDuplicates(["doc_id", "text"]))
