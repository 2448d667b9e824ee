"""Registry and job tables as append-only logs; the current state is the latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The row of largest order per key, as an aggregation: no key is sorted."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def history(log: DataFrame, key: str, order: str, of: object = None) -> DataFrame:
    """A key's changes, newest first, each with what it replaced (``previous``)."""
    rows = log if of is None else log.filter(F.col(key) == of)
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("previous", F.lag("serving_id").over(w)).orderBy(key, F.col(order).desc())


def promote(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Versions with the new ones added, where run and configuration aren't there yet; repeats in `new` come once."""
    fresh = new.dropDuplicates(["run_id", "config_hash"]).join(versions, ["run_id", "config_hash"], "left_anti")
    return versions.unionByName(fresh.select(*versions.columns))


def resolve(names: DataFrame, aliases: DataFrame, versions: DataFrame) -> DataFrame:
    """``name, serving_id`` by alias, else by serving id; null where neither is known."""
    by_alias = aliases.select(F.col("alias").alias("name"), F.col("serving_id").alias("_a"))
    by_id = versions.select(F.col("serving_id").alias("name"), F.col("serving_id").alias("_v"))
    return names.join(by_alias, "name", "left").join(by_id, "name", "left").select("name", F.coalesce("_a", "_v").alias("serving_id"))


def version_list(versions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Versions with their aliases in order, an empty list without any."""
    named = aliases.groupBy("serving_id").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return versions.join(named, "serving_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def numbered(events: DataFrame, key: str, order: str, last: DataFrame) -> DataFrame:
    """Events with ``sequence``: they go on from the last number of their key (`last`: key, max_sequence)."""
    w = Window.partitionBy(key).orderBy(order)
    rows = events.withColumn("_n", F.row_number().over(w)).join(last, key, "left")
    return rows.withColumn("sequence", F.coalesce("max_sequence", F.lit(0)) + F.col("_n")).drop("_n", "max_sequence")


def after(events: DataFrame, key: str, seen: DataFrame) -> DataFrame:
    """Events behind the last one seen of their key (`seen`: key, seen); all of a key that isn't there."""
    return events.join(seen, key, "left").filter(F.col("sequence") > F.coalesce("seen", F.lit(0))).drop("seen")


def open_steps(sessions: DataFrame, steps: list[str]) -> DataFrame:
    """``session, step, ready``: steps not committed, ready if all before them are. `sessions`: session, step, status."""
    order = {s: i for i, s in enumerate(steps)}
    wanted = sessions.select("session").distinct().withColumn("s", F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.lit(i).alias("i")) for s, i in order.items()]))).select("session", "s.*")
    done = sessions.filter("status = 'committed'").select("session", "step").distinct()
    left = wanted.join(done, ["session", "step"], "left_anti")
    first = left.groupBy("session").agg(F.min("i").alias("first"))
    return left.join(first, "session").select("session", "step", (F.col("i") == F.col("first")).alias("ready"))


def decision_log(sessions: DataFrame, steps: list[str]) -> DataFrame:
    """Committed steps of each session in the order of the steps."""
    index = F.create_map(*[x for i, s in enumerate(steps) for x in (F.lit(s), F.lit(i))])
    return sessions.filter("status = 'committed'").withColumn("step_index", index[F.col("step")]).orderBy("session", "step_index")


def unknown_roles(fields: DataFrame, roles: list[str]) -> DataFrame:
    """Fields whose role isn't one of the known ones: what stops a promotion."""
    return fields.filter(~F.col("role").isin(roles) | F.col("role").isNull())


def alias_of_run(aliases: DataFrame, versions: DataFrame, run_id: object, order: str) -> DataFrame:
    """The alias that was last pointed at a version of the run, the first by name of several; no row without any."""
    return aliases.join(versions.filter(F.col("run_id") == run_id), "serving_id").orderBy(F.col(order).desc(), "alias").limit(1)


def recent(log: DataFrame, key: str, of: object, order: list[str], most: int = 100) -> DataFrame:
    """The newest rows of one key of an audit log, newest first, at most that many."""
    return log.filter(F.col(key) == of).orderBy(*[F.col(c).desc() for c in order]).limit(most)
