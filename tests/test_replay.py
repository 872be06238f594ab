"""Replayed books and folds against the last accepted value, against plain Python and for all chunk widths."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.test_folds import LEVELS, fold, level_rows
from tickloom.operators import book as b
from tickloom.operators import depth as dp
from tickloom.operators import flow
from tickloom.operators.accepted import LastAccepted
from tickloom.operators.replay import chunk_marks, ladder_checkpoints, replayed


def plain_measures(book, bands, depth):
    """Measures of one book {(side, ticks): quantity}."""
    bids = sorted(((t, q) for (s, t), q in book.items() if s == "bid"), reverse=True)
    asks = sorted((t, q) for (s, t), q in book.items() if s == "ask")
    out = {"bid_levels": len(bids), "ask_levels": len(asks)}
    for side, lv in (("bid", bids), ("ask", asks)):
        out[f"best_{side}"], out[f"{side}_qty"] = (lv[0][0] / 100, lv[0][1]) if lv else (None, None)
        out[f"{side}s"] = [(t / 100, q) for t, q in lv[:depth]]
    for band in bands:
        for side, lv in (("bid", bids), ("ask", asks)):
            inside = []
            if bids and asks:
                mid = (bids[0][0] / 100 + asks[0][0] / 100) / 2
                inside = [(t, q) for t, q in lv if abs(mid - t / 100) <= mid * band / 10_000]
            out[f"{side}_volume_{band}bps"] = sum(q for _, q in inside)
            out[f"{side}_notional_{band}bps"] = sum(t * q for t, q in inside) / 100
    return out


@pytest.mark.parametrize("chunk", [1, 7, 33, 10_000])
def test_measures_equal_plain_books_at_any_chunk_width(spark, chunk):
    rows = level_rows(11)
    books, bands, depth = fold(rows), (10, 400), 3
    got = replayed(spark.createDataFrame(rows, LEVELS), chunk, bands, depth).collect()
    assert {(r.exchange, r.seq) for r in got} == set(books)
    for r in got:
        for name, want in plain_measures(books[r.exchange, r.seq], bands, depth).items():
            have = r[name]
            assert ([tuple(x) for x in have] if isinstance(want, list) else have) == (want if want is None or isinstance(want, list) else pytest.approx(want)), name


def test_checksums_equal_the_column_form(spark):
    df = spark.createDataFrame(level_rows(12), LEVELS)
    for kind in ("md5", "crc32"):
        fast = {(r.exchange, r.seq): r.checksum for r in b.book_checksum(replayed(df, 9, checksums=(kind,)), kind).collect()}
        assert fast == {(r.exchange, r.seq): r.checksum for r in b.book_checksum(b.books(df, 50), kind).collect()}


def test_operators_agree_on_measures_and_arrays(spark):
    df = spark.createDataFrame(level_rows(13), LEVELS)
    fast, arrays = replayed(df, 20, (10, 20), 5), b.books(df, 20)
    for op in (dp.top_of_book, dp.wap_depth, dp.volume_at_depth, dp.book_imbalance, dp.liquidity_imbalance_qty, dp.liquidity_imbalance_notional,
               dp.queue_imbalance_levels, dp.queue_imbalance_top5):
        new = [c for c in op(arrays).columns if c not in arrays.columns]
        rows = [{(r.exchange, r.seq): [None if r[c] is None else round(r[c], 9) for c in new] for r in op(x).collect()} for x in (fast, arrays)]
        assert rows[0] == rows[1], op.__name__


def test_checkpoints_are_bounded_by_chunks_and_live_levels(spark):
    """A long gap in seq makes no checkpoint, and a snapshot ends the levels before it."""
    far = 10**12
    rows = [("x", None, s, s, s, s in (1, far), "bid", t, t / 100, q) for s, t, q in
            [(1, 100, 1.0), (2, 101, 2.0), (3, 100, 0.0), (far, 90, 1.0), (far + 1, 91, 2.0), (far + 500, 92, 3.0)]]
    df = spark.createDataFrame(rows, LEVELS)
    held = ladder_checkpoints(df, 100, chunk_marks(df, 100)).collect()
    assert sorted((r._chunk, r.price_ticks) for r in held) == [(far // 100, 101), (far // 100 + 5, 90), (far // 100 + 5, 91)]
    got = {r.seq: [x.quantity for x in r.bids] for r in b.books(df, 100).collect()}
    assert got == {1: [1.0], 2: [2.0, 1.0], 3: [2.0], far: [1.0], far + 1: [2.0, 1.0], far + 500: [3.0, 2.0, 1.0]}


def test_plan_has_no_row_per_message_and_level(spark):
    plan = replayed(spark.createDataFrame(level_rows(14), LEVELS), 20, (10,))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "_bucket" not in plan and "MapInArrow" in plan


# --- last accepted value ---------------------------------------------------------------------

TRADES = "exchange string, symbol string, ts_us long, trade_id long, price double, quantity double"


def trade_rows(seed, n=400, wild=0.2):
    rnd, price = random.Random(seed), {"hot": 100.0, "cold": 5.0, None: 1.0}
    out = []
    for i in range(n):
        key = rnd.choice(["hot", "hot", "hot", "cold", None])
        price[key] *= 1 + rnd.uniform(-0.03, 0.03)
        p = price[key] * (rnd.choice([0.5, 1.4, 2.0, 10.0]) if rnd.random() < wild else 1)
        out.append((key, "s", 1000 * i, i, rnd.choice([p] * 20 + [0.0, -1.0, None]), rnd.choice([1.0] * 20 + [0.0])))
    return out


def plain_violations(rows, limit):
    last, out = {}, {}
    for key, _, ts, i, price, quantity in rows:
        out[i] = None
        if price is not None and price <= 0:
            out[i] = "invalid_price"
        elif quantity <= 0:
            out[i] = "invalid_quantity"
        elif price is not None:
            if key in last and abs((price - last[key]) / last[key]) * 100 > limit:
                out[i] = "outlier"
            else:
                last[key] = price
    return out


@pytest.mark.parametrize("seed,limit", [(1, 3.5), (2, 30), (3, 120)])
def test_trades_against_the_last_accepted_price_at_any_chunk_width(spark, seed, limit):
    rows = trade_rows(seed)
    want = plain_violations(rows, limit)
    assert "outlier" in want.values() or limit > 100
    for chunk_us in (1000, 7000, 50_000, 10**9):
        got = flow.trade_validation(spark.createDataFrame(rows, TRADES), limit, 10**12, F.lit(10**6), chunk_us=chunk_us)
        assert {r.trade_id: r.violation for r in got.collect()} == want, chunk_us


def test_the_return_from_a_spike_is_no_outlier(spark):
    rows = [("x", "s", i, i, p, 1.0) for i, p in enumerate([10.0, 10.0, 20.0, 10.0])]
    got = flow.trade_validation(spark.createDataFrame(rows, TRADES), 10, 10**12, F.lit(10), chunk_us=2)
    assert {r.trade_id: r.violation for r in got.collect()} == {0: None, 1: None, 2: "outlier", 3: None}


def test_a_chunk_is_described_by_few_rows():
    check = LastAccepted(5.0)
    chunk = check.describe()
    rnd, price = random.Random(5), 100.0
    for _ in range(5000):
        price *= 1 + rnd.uniform(-0.001, 0.001)
        chunk.add(True, price)
    assert len(chunk.result()) < 10
    for entry in (None, 1.0, 95.0, 100.0, 103.0, 200.0):
        state = entry
        again, p = random.Random(5), 100.0
        for _ in range(5000):
            p *= 1 + again.uniform(-0.001, 0.001)
            state, _ = check.step(state, True, p)
        assert check.advance(entry, chunk.result()) == state


def test_book_validation_against_the_last_accepted_mid(spark):
    level = "array<struct<price:double,quantity:double>>"
    mids = [10.0, 20.0, 10.1, None, 10.2, 5.0, 10.3]
    rows = [("x", "s", i, i, [] if m is None else [(m - 0.5, 1.0)], [(m + 0.5 if m else 99.0, 1.0)]) for i, m in enumerate(mids)]
    df = spark.createDataFrame(rows, f"exchange string, symbol string, seq long, ts_us long, bids {level}, asks {level}")
    for chunk in (1, 3, 100):
        got = {r.seq: r.violation for r in b.book_validation(df, chunk, 5.0, 10**9, F.lit(10)).collect()}
        assert got == {0: None, 1: "outlier", 2: None, 3: None, 4: None, 5: "outlier", 6: None}


# --- ladders that forget ---------------------------------------------------------------------


def forgetful(rows, depth):
    held, out, epoch = {}, {}, {}
    for key, symbol, seq, _, _, snap, side, tick, _, q in sorted(rows, key=lambda r: (str(r[0]), r[2], r[6], r[7])):
        if snap and epoch.get(key) != seq:
            epoch[key] = seq
            held[key] = {"bid": {}, "ask": {}}
        if key not in epoch:
            continue
        mine = held[key][side]
        if q == 0:
            mine.pop(tick, None)
        else:
            mine[tick] = q
            if len(mine) > depth:
                mine.pop(min(mine) if side == "bid" else max(mine))
        out[key, side, seq] = (epoch[key], len(mine), (max(mine) if side == "bid" else min(mine)) if mine else None, sum(mine.values()))
    return out


def deep_rows(seed, n=240, snapshots=(0,)):
    """Many levels and few kept ones, so that levels are forgotten and better ones go away later."""
    rnd, out = random.Random(seed), []
    for seq in range(n):
        key = "hot" if seq % 4 or seq in snapshots else None
        for tick in sorted({rnd.randint(1, 40) for _ in range(rnd.randint(1, 3))}):
            side = rnd.choice(["bid", "ask"])
            out.append((key, "s", seq, seq, seq, seq in snapshots, side, tick, tick / 100, rnd.choice([0.0, 0.0, 1.0, 2.0, 3.0])))
    return out


@pytest.mark.parametrize("rounds", [0, 1, 9])
def test_forgetting_ladders_equal_the_fold_in_order(spark, rounds):
    rows = deep_rows(3, snapshots=(0, 150)) + [(None, "s", 1000 + i, i, 1000 + i, i == 0, "bid", 5 + i % 9, 0.05, float(i % 3)) for i in range(60)]
    df, want = spark.createDataFrame(rows, LEVELS), forgetful(rows, 4)
    for chunk in (10, 60):
        got = {(r.exchange, r.side, r.seq): (r.epoch, r.levels, r.best_ticks, r.quantity) for r in b.fixed_depth_book(df, chunk, 4, rounds).collect()}
        assert got == want, chunk


def test_old_messages_are_skipped_by_a_forgetting_ladder(spark):
    rows = [("x", "s", seq, seq, ids, seq == 1, "bid", tick, tick / 100, 1.0) for seq, ids, tick in ((1, 10, 5), (2, 12, 6), (3, 11, 9), (4, 12, 9), (5, 13, 7))]
    got = b.fixed_depth_book(spark.createDataFrame(rows, LEVELS), 2, 20).orderBy("seq").collect()
    assert [(r.seq, r.best_ticks) for r in got] == [(1, 5), (2, 6), (5, 7)]
