"""A replay that goes on from a checkpoint, and a stream of events in any cut, against the whole replay."""

import pytest
from pyspark.sql import functions as F
from test_book import COLUMNS, random_events

from tidebook.operators import book, checkpoint
from tidebook.schemas import FLAG_LAST, FLAG_SNAPSHOT
from tidebook.streaming.book import replayed

FIELDS = ["seq", "ts_ns", "side", "tick", "d_depth", "add", "pull", "fill", "touched"]


def changes_of(df):
    return sorted(tuple(r) for r in df.select(FIELDS).collect())


@pytest.fixture(scope="module")
def events(spark):
    rows = random_events(300, 12)
    assert sum(r[2] == "R" for r in rows) > 1
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def whole(events):
    return changes_of(book.changes(events))


def orders_of(df):
    return sorted(tuple(r) for r in df.select("order_id", "side", "tick", "qty").collect())


@pytest.mark.parametrize("at", [0, 150, 298])
def test_restored_replay_is_the_whole_replay(spark, events, whole, tmp_path, at):
    path = f"file://{tmp_path}/book"
    checkpoint.save(events.filter(F.col("seq") <= at), path, "feed", "2024-01-03")
    start = checkpoint.load(spark, path, "feed", "2024-01-03", at)
    assert changes_of(checkpoint.changes(events, start)) == [r for r in whole if r[0] > at]
    depth = {(r.side, r.tick): r.depth for r in checkpoint.depth(start).collect()}
    want = {}
    for r in whole:
        if r[0] <= at:
            want[r[2], r[3]] = want.get((r[2], r[3]), 0) + r[4]
    assert depth == {k: v for k, v in want.items() if v}
    assert start.best_bid == max((t for s, t in depth if s == "B"), default=None) and start.best_ask == min((t for s, t in depth if s == "A"), default=None)
    end = checkpoint.save(events, f"{path}-end", "feed", "2024-01-03", start)
    assert end.last_seq == 299 and orders_of(end.orders) == orders_of(book.resting(events))


def test_wrong_fingerprints_are_errors(spark, events, tmp_path):
    path = f"file://{tmp_path}/book"
    checkpoint.save(events, path, "feed", "2024-01-03")
    for wrong in (("other", "2024-01-03", None), ("feed", "2024-01-04", None), ("feed", "2024-01-03", 7)):
        with pytest.raises(ValueError, match="the checkpoint"):
            checkpoint.load(spark, path, *wrong)
    with pytest.raises(ValueError, match="no checkpoint"):
        checkpoint.load(spark, f"{path}-none", "feed", "2024-01-03")
    checkpoint.load(spark, path, "feed", "2024-01-03").orders.withColumn("qty", F.col("qty") + 1).write.parquet(f"{path}-bad")
    spark.read.parquet(f"{path}-bad").write.mode("overwrite").parquet(f"{path}/orders")
    with pytest.raises(ValueError, match="aren't those"):
        checkpoint.load(spark, path, "feed", "2024-01-03")


def test_snapshot_that_a_checkpoint_cuts(spark, tmp_path):
    rows = [(0, 0, "R", "B", 1, 1, 1, FLAG_SNAPSHOT), (1, 1, "A", "B", 1, 5, 2, FLAG_SNAPSHOT), (2, 2, "A", "A", 4, 5, 3, FLAG_SNAPSHOT | FLAG_LAST), (3, 3, "A", "B", 2, 1, 4, 0)]
    events = spark.createDataFrame(rows, COLUMNS)
    start, valid = None, []
    for i, r in enumerate(rows):
        start = checkpoint.save(spark.createDataFrame([r], COLUMNS), f"file://{tmp_path}/{i}", "feed", "day", start)
        valid.append(start.valid)
    assert valid == [False, False, True, True] and (start.best_bid, start.best_ask) == (2, 4)
    empty = checkpoint.save(events.limit(0), f"file://{tmp_path}/none", "feed", "day")
    assert (empty.last_seq, empty.valid, empty.orders.count()) == (-1, True, 0)


@pytest.mark.parametrize("cuts", [[0, 300], [0, 120, 121, 300]])
def test_stream_in_any_cut(spark, events, whole, tmp_path, cuts):
    found = None
    for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        # the last piece has events of earlier ones again
        events.filter((F.col("seq") >= (a if i < 2 else 0)) & (F.col("seq") < z)).write.parquet(f"file://{tmp_path}/in/{i}")
        source = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
        found = replayed(source, spark, f"file://{tmp_path}/out", "feed", "day")
    assert changes_of(found) == whole


def test_advance_is_save_and_changes_from_states_found_once(spark, tmp_path, monkeypatch):
    events = spark.createDataFrame(random_events(300, 5), COLUMNS)
    early, late = events.filter("seq <= 140"), events.filter("seq > 140")
    first, moved = checkpoint.advance(early, f"{tmp_path}/a", "x", "d")
    assert sorted(moved.collect()) == sorted(checkpoint.changes(early, None).collect())
    want = sorted(checkpoint.changes(late, first).collect())
    kept = checkpoint.save(late, f"{tmp_path}/b", "x", "d", first)
    found, of = [], book.order_states
    monkeypatch.setattr(book, "order_states", lambda *a, **k: found.append(1) or of(*a, **k))
    again, moved = checkpoint.advance(late, f"{tmp_path}/c", "x", "d", first)
    assert sorted(moved.collect()) == want and len(found) == 1
    assert sorted(again.orders.collect()) == sorted(kept.orders.collect()) == sorted(book.resting(events).select(*again.orders.columns).collect())
