"""The book as windows against an event-by-event replay, and the chunked fold against one in a single piece."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.operators import book, fold, levels
from tidebook.schemas import FLAG_LAST, FLAG_SNAPSHOT

COLUMNS = "seq bigint, ts_ns bigint, action string, side string, tick int, size bigint, order_id bigint, flags int"


def random_events(n, seed):
    rng = random.Random(seed)
    rows, ts = [], 1_000_000_000
    for seq in range(n):
        ts += rng.choice([0, 0, 20_000_000, 300_000_000])
        action = rng.choices("AACMFTR", [8, 8, 4, 4, 6, 1, 0.2])[0]
        new = action == "A"
        rows.append((seq, ts, action, rng.choice("BA"), rng.randrange(5), rng.randrange(1, 9), 1000 + seq if new else 1000 + rng.randrange(max(1, seq)), 0))
    return rows


class Replay:
    """A book of orders, and per tick the same mechanics as the engine, one event after another."""

    def __init__(self):
        self.orders, self.depth, self.rows = {}, defaultdict(int), []

    def event(self, seq, ts, action, side, tick, size, oid):
        old = self.orders.get(oid)
        if action == "R":
            self.orders.clear()
            self.depth.clear()
        elif action == "A":
            self.orders[oid] = [side, tick, size]
            self.depth[side, tick] += size
            return [(tick, size, 0, 0)]
        elif action == "C" and old:
            del self.orders[oid]
            self.depth[old[0], old[1]] -= old[2]
            return [(old[1], 0, old[2], 0)]
        elif action == "F" and old:
            taken = min(size, old[2])
            old[2] -= taken
            self.depth[old[0], old[1]] -= taken
            if not old[2]:
                del self.orders[oid]
            return [(old[1], 0, 0, taken)]
        elif action == "M":
            if old:
                self.depth[old[0], old[1]] -= old[2]
            self.orders[oid] = [side, tick, size]
            self.depth[side, tick] += size
            if old and (old[0], old[1]) == (side, tick):
                return [(tick, max(0, size - old[2]), max(0, old[2] - size), 0)]
            if old:
                return [(old[1], 0, old[2], 0), (tick, size, 0, 0)]
        return []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay(spark, seed):
    rows, r = random_events(300, seed), Replay()
    touched = []
    for seq, ts, action, side, tick, size, oid, _ in rows:
        touched += [(seq, *t) for t in r.event(seq, ts, action, side, tick, size, oid)]
    events = spark.createDataFrame(rows, COLUMNS)
    got = {(x.order_id, x.side, x.tick, x.qty) for x in book.resting(events).collect()}
    assert got == {(o, *v) for o, v in r.orders.items()}
    changed = book.changes(events)
    depth = {(x.side, x.tick): x.d for x in changed.groupBy("side", "tick").agg(F.sum("d_depth").alias("d")).collect() if x.d}
    assert depth == {k: v for k, v in r.depth.items() if v}
    mine = sorted((x.seq, x.tick, x.add, x.pull, x.fill) for x in changed.filter("touched").collect())
    assert mine == sorted(touched)


def test_snapshot_states(spark):
    rows = [(0, "R", FLAG_SNAPSHOT), (1, "A", FLAG_SNAPSHOT), (2, "A", FLAG_SNAPSHOT | FLAG_LAST), (3, "A", 0), (4, "R", 0), (5, "A", 0)]
    df = spark.createDataFrame(rows, "seq bigint, action string, flags int")
    assert [x.valid for x in book.book_valid(df).orderBy("seq").collect()] == [False, False, True, True, True, True]


def test_best_prices_and_lattice(spark):
    rows = [(0, "B", 3, 5), (0, "B", 2, 5), (0, "A", 6, 4), (1, "B", 3, -5), (2, "A", 6, -4)]
    changed = spark.createDataFrame(rows, "bin_seq bigint, side string, tick int, d_depth bigint")
    best = levels.best_prices(levels.intervals(changed), 0, 2)
    assert [(x.best_bid, x.best_ask, x.spot) for x in best.orderBy("bin_seq").collect()] == [(3, 6, 5), (2, 6, 4), (2, None, None)]
    near = {(x.bin_seq, x.k): (x.bid_depth, x.ask_depth) for x in levels.around_spot(changed, best, 2).collect()}
    assert len(near) == 10 and near[0, -2] == (5, 0) and near[0, 1] == (0, 4) and near[1, -2] == (5, 0) and near[1, 2] == (0, 4) and near[0, 0] == (0, 0)
    none = levels.best_prices(levels.intervals(changed.limit(0)), 0, -1)
    assert none.count() == 0 and levels.around_spot(changed.limit(0), none, 2).count() == 0


@pytest.mark.parametrize("seed, first, n", [(1, 0, 40), (2, 7, 129), (3, -20, 64)])
def test_sparse_depth_against_dense(spark, monkeypatch, seed, first, n):
    """Intervals, best prices and depth around the spot against depths of all ticks and bins, whatever the chunks."""
    rng = random.Random(seed)
    rows = [(first + rng.choice([0, n - 1, *[rng.randrange(n)] * 9]), rng.choice("AB"), rng.randrange(8), rng.choice([5, 3, -3, -4, 0])) for _ in range(150)]
    changed = spark.createDataFrame(rows, "bin_seq bigint, side string, tick int, d_depth bigint")
    monkeypatch.setattr("tidebook.functions.totals.running_totals.__defaults__", (16, (), None))
    dense = defaultdict(int)
    for b, side, tick, d in rows:
        for later in range(b, first + n):
            dense[later, side, tick] += d
    held = levels.intervals(changed).collect()
    assert {(b, x.side, x.tick): x.depth for x in held for b in range(x.since, first + n if x.until is None else x.until)} == {k: v for k, v in dense.items() if v}
    want = {}
    for b in range(first, first + n):
        at = {(s, t): d for (c, s, t), d in dense.items() if c == b and d}
        bids, asks = ({t: d for (s, t), d in at.items() if s == side and d > 0} for side in "BA")
        bid, ask = max(bids, default=None), min(asks, default=None)
        want[b] = (bid, ask, sum(bids.values()), sum(asks.values()), sum(d < 0 for d in at.values()), None if bid is None or ask is None else (bid + ask + 1) // 2)
    best = levels.best_prices(levels.intervals(changed), first, first + n - 1, block=2 * seed)
    assert {x.bin_seq: (x.best_bid, x.best_ask, x.bid_depth, x.ask_depth, x.n_negative, x.spot) for x in best.collect()} == want
    near = {(x.bin_seq, x.k): (x.bid_depth, x.ask_depth) for x in levels.around_spot(changed, best, 2).collect()}
    assert near == {(b, k): (dense[b, "B", w[5] + k], dense[b, "A", w[5] + k]) for b, w in want.items() if w[5] is not None for k in range(-2, 3)}


def test_rows_grow_with_changes(spark):
    """A thousand ticks that change twice within a million bins: rows are those of the changes, times the span lengths."""
    n = 1 << 20
    changed = spark.range(1000).select(F.explode(F.array(F.col("id") * 37, F.lit(n - 1) - F.col("id") * 41)).alias("bin_seq"), F.lit("B").alias("side"), F.col("id").cast("int").alias("tick"), F.lit(1).cast("long").alias("d_depth"))
    held = levels.intervals(changed)
    assert held.count() == 2000
    levels_n = (n - 1).bit_length() + 1
    parts = levels.spans(held.withColumn("until", F.coalesce("until", F.lit(n))), "since", "until", levels_n)
    assert parts.count() <= 2000 * 2 * levels_n
    assert parts.select(F.sum(F.expr("1L << level"))).first()[0] == held.select(F.sum(F.coalesce("until", F.lit(n)) - F.col("since"))).first()[0]


def fold_tick(rows):
    """State after each row of one tick, one event after another; rows are (ts, event, add, pull, fill, d_bid, d_ask)."""
    mass, chains, clock, out = [0.0] * 3, [(0.0, 0.0, 0.0)] * 5, None, []
    for ts, event, *deltas in rows:
        dt = (ts - clock) / 1e9 if clock is not None and ts > clock else 0.0
        if dt > 0:
            mass = [m * math.exp(-dt / fold.TAU_MASS) for m in mass]
            av, aa, aj = (-math.expm1(-dt / tau) for tau in (fold.TAU_V, fold.TAU_A, fold.TAU_J))
            for i, (v, a, j) in enumerate(chains):
                v2 = av * (deltas[i] / dt if event else 0.0) + (1 - av) * v
                a2 = aa * (v2 - v) / dt + (1 - aa) * a
                chains = [*chains[:i], (v2, a2, aj * (a2 - a) / dt + (1 - aj) * j), *chains[i + 1 :]]
        if event:
            mass = [m + d for m, d in zip(mass, deltas, strict=False)]
        clock = ts if event else clock if clock is None else max(clock, ts)
        out.append([*mass, *[x for d in range(3) for x in (*[c[d] for c in chains], chains[3][d] + chains[4][d])]])
    return out


@pytest.mark.parametrize("chunk", [1800, 100_000])
def test_mechanics(spark, chunk):
    """Whatever the chunks, the scan over arrays gives what one event after another gives."""
    rows = random_events(400, 9)
    events = spark.createDataFrame(rows, COLUMNS)
    t0, width = 1_000_000_000, 1_000_000_000
    changed = book.changes(events).withColumn("bin_seq", F.expr(f"(ts_ns - {t0}) div {width}"))
    n = int(max(x[1] for x in rows) - t0) // width + 1
    got = fold.mechanics(changed, n, width, t0, chunk).toPandas()
    assert len(got) == len(got.drop_duplicates(["tick", "bin_seq"]))
    by_tick = defaultdict(list)
    for r in changed.collect():
        bid, ask = (r.d_depth if r.side == side else 0 for side in "BA")
        by_tick[r.tick].append((r.bin_seq, r.seq, r.add, r.pull, r.fill, bid, ask, r.ts_ns, r.touched))
    expected, depths = {}, {}
    for tick, own in by_tick.items():
        own.sort()
        bid = ask = waiting_bid = waiting_ask = 0
        folded, ends, at = [], [], 0
        for b in range(n):
            while at < len(own) and own[at][0] == b:
                _, _, add, pull, fill, db, da, ts, touched = own[at]
                bid, ask, at = bid + db, ask + da, at + 1
                waiting_bid, waiting_ask = waiting_bid + db, waiting_ask + da
                if touched:
                    folded.append((ts, True, add, pull, fill, waiting_bid, waiting_ask))
                    waiting_bid = waiting_ask = 0
            if folded:
                folded.append((t0 + (b + 1) * width, False, 0, 0, 0, 0, 0))
                ends.append((b, len(folded) - 1))
                depths[tick, b] = (bid, ask)
        states = fold_tick(folded)
        expected |= {(tick, b): states[i] for b, i in ends}
    got = {(r["tick"], r["bin_seq"]): r for r in got.to_dict("records")}
    assert got.keys() == expected.keys() and len(got) > 50
    for k, r in got.items():
        np.testing.assert_allclose([r[c] for c in fold.STATE], expected[k], atol=1e-9)
        assert (r["bid_depth"], r["ask_depth"]) == depths[k]


def test_scan_against_loop():
    """Many rows at once, of several ticks, with equal and falling times."""
    rng = np.random.default_rng(4)
    tick = np.sort(rng.integers(0, 7, 4000))
    ts = np.cumsum(rng.choice([0, -5, 1, 10**6, 10**9, 40 * 10**9], 4000, p=[0.2, 0.05, 0.25, 0.3, 0.19, 0.01]))
    event = rng.random(4000) < 0.9
    moves = np.where(event[:, None], rng.integers(-9, 9, (4000, 5)), 0).astype(float)
    got = fold.fold_rows(tick, ts, event, moves)
    for t in range(7):
        at = np.flatnonzero(tick == t)
        # a bin's end before the first event has no clock yet
        at = at[np.flatnonzero(event[at])[0] :]
        first = got[at] if at[0] == np.flatnonzero(tick == t)[0] else fold.fold_rows(tick[at], ts[at], event[at], moves[at])
        want = np.array(fold_tick([(int(ts[i]), bool(event[i]), *moves[i]) for i in at]))
        np.testing.assert_allclose(first, want, rtol=1e-9, atol=1e-9 * max(1, np.abs(want).max()))


def test_analytic_chain():
    """One addition of 10 half a second after the tick's first touch."""
    moves = np.array([[10.0, 0, 0, 10, 0]] * 2)
    s = dict(zip(fold.STATE, fold.fold_rows(np.zeros(2), np.array([10**9, 15 * 10**8]), np.ones(2, bool), moves)[1], strict=True))
    alpha = lambda tau: 1 - np.exp(-0.5 / tau)
    v = alpha(2) * 20
    assert s["v_add"] == pytest.approx(v)
    assert s["a_add"] == pytest.approx(alpha(5) * v / 0.5)
    assert s["j_add"] == pytest.approx(alpha(10) * s["a_add"] / 0.5)
    assert s["add_mass"] == pytest.approx(10 * np.exp(-0.5 / 30) + 10)
    assert s["v_rest_depth"] == pytest.approx(v)


def test_anchor_is_the_first_two_sided_book(spark):
    rows = [(1, 10, "B", 3, 5), (2, 20, "B", 4, 5), (3, 30, "B", 4, -5), (4, 40, "A", 8, 2), (5, 50, "A", 6, 2), (6, 60, "B", 5, 1)]
    changed = spark.createDataFrame(rows, "seq bigint, ts_ns bigint, side string, tick int, d_depth bigint")
    for chunk in (1, 1 << 20):
        assert book.anchor(changed, chunk=chunk) == {"seq": 4, "best_bid": 3, "best_ask": 8, "anchor": 6}
        assert book.anchor(changed, after=5, chunk=chunk) == {"seq": 5, "best_bid": 3, "best_ask": 6, "anchor": 5}
        assert book.anchor(changed, after=99, at_ns=60, chunk=chunk) == {"seq": 6, "best_bid": 5, "best_ask": 6, "anchor": 6}
    assert book.anchor(changed, after=99) is None and book.anchor(changed.limit(0)) is None and book.anchor(changed.filter("side = 'B'")) is None


def test_anchor_of_random_books(spark):
    events = random_events(300, 5)
    changed = book.changes(spark.createDataFrame(events, COLUMNS)).toPandas()
    levels, expected = defaultdict(int), None
    for seq, part in changed.sort_values("seq").groupby("seq"):
        for r in part.itertuples():
            levels[r.side, r.tick] += r.d_depth
        bids, asks = ([t for (s, t), d in levels.items() if s == side and d > 0] for side in "BA")
        if bids and asks:
            expected = (seq, max(bids), min(asks))
            break
    got = book.anchor(spark.createDataFrame(changed))
    assert (got["seq"], got["best_bid"], got["best_ask"]) == expected


def test_restart_keeps_depth_and_forgets_masses(spark):
    changed = spark.createDataFrame([(1, 2, "B", 3, 5, 5, 0, 0, True), (9, 10, "B", 3, 2, 2, 0, 0, True)], "seq bigint, ts_ns bigint, side string, tick int, d_depth bigint, add bigint, pull bigint, fill bigint, touched boolean")
    df = book.restarted(changed, 4).withColumn("bin_seq", F.lit(0).cast("long"))
    row = fold.mechanics(df, 1, 1_000_000_000, 1).collect()[0]
    assert row.bid_depth == 7 and row.add_mass == pytest.approx(2, rel=0.05) and row.v_add == 0


def test_full_grid_drops_or_refuses_what_is_outside(spark):
    changed = spark.createDataFrame([(0, "B", 10, 4), (2, "A", 11, 3), (2, "B", 40, 9)], "bin_seq bigint, side string, tick int, d_depth bigint")
    rows = {(r.bin_seq, r.side, r.cell): r.depth for r in book.full_grid(changed, changed.select("bin_seq"), 10, 1).collect()}
    assert len(rows) == 3 * 2 * 3
    assert {x: d for x, d in rows.items() if d} == {(0, "B", 1): 4, (1, "B", 1): 4, (2, "B", 1): 4, (2, "A", 2): 3}
    with pytest.raises(Exception, match="tick 40 is outside the grid"):
        book.full_grid(changed, changed.select("bin_seq"), 10, 1, strict=True).collect()
    assert book.full_grid(changed.limit(0), changed.select("bin_seq").limit(0), 10, 1).count() == 0


def test_mechanics_of_crowded_moments(spark):
    """Many changes of a tick at one moment, some that touch nothing among them, fold as two rows a moment."""
    rng, columns = np.random.default_rng(8), ["tick", "bin_seq", "seq", "ts_ns", *fold.MOVES, "touched"]
    rows = []
    for _ in range(3000):
        b, x, kind = int(rng.integers(0, 6)), int(rng.integers(0, 2)), int(rng.integers(0, 4))
        size, depth = int(rng.integers(1, 9)), int(rng.integers(-9, 9))
        moved = [size * (kind == i) for i in range(3)]
        rows.append((int(rng.integers(0, 3)), b, 2 * b + x, b * 10**9 + x * 10**8, *moved, depth * x, depth * (1 - x), kind < 3))
    moves = spark.createDataFrame(rows, ", ".join(f"{c} {'boolean' if c == 'touched' else 'int' if c == 'tick' else 'long'}" for c in columns))
    found = fold.moments(moves).toPandas()
    assert found[found["touched"]].groupby(["tick", "seq"]).size().max() == 2
    got, want = (fold.fold_chunk(x, 0, 6, 10**9, 0) for x in (found, moves.toPandas()))
    np.testing.assert_array_equal(got[["tick", "bin_seq"]], want[["tick", "bin_seq"]])
    np.testing.assert_allclose(got[fold.STATE], want[fold.STATE], rtol=1e-9, atol=1e-9)
