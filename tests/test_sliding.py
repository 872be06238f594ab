"""Sliding measures against a list per frame, for any chunk width, and their cost."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import flow
from tickloom.plans import sliding as sl

SCHEMA = "k string, ts long, id long, v double, w double"


def rows_of(seed, n=500):
    rnd = random.Random(seed)
    out, ts = [], 0
    for i in range(n):
        ts += rnd.choice([0, 0, 1, 3, 20, 300])
        out.append((rnd.choice(["hot", "hot", "cold", None]), ts, i, rnd.choice([None, 0.1, 0.2, 0.3, -7.25, 1e-9, 123456.789, rnd.random()]), float(rnd.randint(-9, 9))))
    return out


def plain(rows, width, share):
    out = {}
    for k, ts, i, _, _ in rows:
        frame = [r for r in rows if r[0] == k and ts - width <= r[1] <= ts]
        vs = [r[3] for r in sorted(frame, key=lambda r: r[1:3]) if r[3] is not None]
        sizes = sorted(abs(r[4]) for r in frame)
        cut = sizes[min(math.floor(len(sizes) * share), len(sizes) - 1)]
        big = [r[4] for r in frame if abs(r[4]) >= cut]
        out[i] = (
            sum(vs) if vs else None, len(frame), sum(r[4] > 0 for r in frame), min(vs, default=None), max(vs, default=None), vs[0] if vs else None,
            float(np.std(vs)) if vs else None, cut, sum(big), sum(map(abs, big)))
    return out


@pytest.mark.parametrize("seed,share", [(1, 0.9), (2, 0.0), (3, 0.5)])
def test_measures_equal_a_list_per_frame_at_any_chunk_width(spark, seed, share):
    rows, width = rows_of(seed), 40
    df, want = spark.createDataFrame(rows, SCHEMA), plain(rows, width, share)
    narrow = plain(rows, 7, share)
    v, seen = F.col("v"), []
    size, net, both = sl.upper_part(F.col("w"), share)
    for chunk in (40, 170, 10**6):
        got = sl.sliding(
            df, ["k"], "ts", width, chunk, ["id"], total=sl.total(v), n=sl.rows(), up=sl.rows(F.col("w") > 0), low=sl.least(v), high=sl.greatest(v),
            first=sl.earliest(v), std=sl.spread(v), cut=size, net=net, both=both, near=sl.total(v, 7)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert tuple(r[5:15]) == pytest.approx(want[r.id], abs=1e-9), (chunk, r.id)
            assert r.near == pytest.approx(narrow[r.id][0], abs=1e-9)
        seen.append({r.id: tuple(r) for r in got})
    assert seen[0] == seen[1] == seen[2]  # to the last bit


def test_equal_values_do_not_deviate(spark):
    df = spark.createDataFrame([("x", i, i, 100.1 + (i > 50) * 0.2, 0.0) for i in range(100)], SCHEMA)
    got = {r.id: r.s for r in sl.sliding(df, ["k"], "ts", 10, 25, s=sl.spread(F.col("v"))).collect()}
    assert got[5] == got[50] == got[99] == 0.0 and got[55] > 0.09


def test_non_finite_values_stay_inside_their_frames(spark):
    df = spark.createDataFrame([("x", i, i, float("nan") if i == 3 else 1.0, 0.0) for i in range(10)], SCHEMA)
    got = [r.t for r in sl.sliding(df, ["k"], "ts", 2, 100, t=sl.total(F.col("v"))).orderBy("id").collect()]
    assert [math.isnan(x) for x in got] == [3 <= i <= 5 for i in range(10)] and got[9] == 3.0


def test_cost_does_not_grow_with_what_a_frame_holds():
    """The same rows under a frame of 10 and of 10,000 rows: about the same time."""
    n = 40_000
    values = np.random.default_rng(0).standard_normal(n)
    took = []
    for held in (10, 10_000):
        end = np.arange(1, n + 1)
        start = np.maximum(end - held, 0)
        begin = time.perf_counter()
        sl.upper_parts(values, start, end, 0.9)
        sl.extremes(values, start, end, np.minimum)
        sl.Sums(values).of(start, end)
        took.append(time.perf_counter() - begin)
    assert took[1] < 5 * took[0] + 0.05


@pytest.mark.parametrize("seed", [4, 5])
def test_totals_and_counts_equal_a_list_per_frame(spark, seed):
    rows = rows_of(seed)
    df, want, narrow = spark.createDataFrame(rows, SCHEMA), plain(rows, 40, 0.5), plain(rows, 7, 0.5)
    v, seen = F.col("v"), []
    for chunk in (40, 170, 10**6):
        got = sl.sliding(df, ["k"], "ts", 40, chunk, t=sl.total(v), n=sl.rows(), up=sl.rows(F.col("w") > 0), near=sl.total(v, 7)).collect()
        for r in got:
            assert (r.t, r.n, r.up) == pytest.approx(want[r.id][:3], abs=1e-6) and r.near == pytest.approx(narrow[r.id][0], abs=1e-6), (chunk, r.id)
        seen.append({r.id: tuple(r) for r in got})
    assert len(seen[0]) == len(rows) and seen[0] == seen[1] == seen[2]


def test_windows_leave_no_sliding_frame_in_the_plan(spark):
    trades = spark.createDataFrame([("x", "s", 1, 1, "buy", 1.0, 1.0)], "exchange string, symbol string, ts_us long, trade_id long, side string, price double, quantity double")
    for op in (flow.rolling_vwap(trades, 10), flow.large_trade_imbalance(trades, 10, 0.9), flow.price_momentum(trades, 5, 10)):
        plan = op._jdf.queryExecution().executedPlan().toString()
        assert "RangeFrame, -" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_group_is_not_held_whole(monkeypatch):
    """One key and chunk in many batches: frames go out as soon as time has passed them, and are those of the whole."""
    import numpy as np
    import pyarrow as pa

    from tickloom.plans import sliding as sl

    n, rng = 4 * sl.BLOCK, np.random.default_rng(3)
    t = np.sort(rng.integers(0, 100_000, n))
    rows = pa.record_batch({
        "k": pa.array([None] * n, pa.string()), sl.CHUNK: pa.array(np.zeros(n, np.int64)), "t": pa.array(t), sl.HALO: pa.array(t < 500),
        "v": pa.array(rng.integers(0, 1000, n).astype(float), mask=rng.random(n) < 0.1)})
    kinds = [("a", sl.Measure("total", None), "v"), ("b", sl.Measure("least", None, 200), "v"), ("c", sl.Measure("earliest", None), "v"), ("d", sl.Measure("rows", None), "v")]
    run = sl._worker(["k"], "t", 700, 100_000, kinds, ["t"])
    read = []

    def batches():
        for i in range(0, n, 5_000):
            read.append(i)
            yield rows.slice(i, 5_000)

    parts = run(batches())
    first = next(parts)
    assert len(read) * 5_000 < n / 2 and first.num_rows
    got = pa.Table.from_batches([first, *parts])
    monkeypatch.setattr(sl, "BLOCK", 1 << 40)
    (whole,) = run(iter([rows]))
    assert got.combine_chunks().equals(pa.Table.from_batches([whole]))


def test_totals_of_one_value_over_several_widths_are_carried_once(spark):
    df = spark.createDataFrame([("k", t, float(t % 5) if t % 7 else None) for t in range(60)], "k string, ts long, v double")
    out = sl.sliding(df, ["k"], "ts", 20, 40, **{f"s{w}": sl.total(F.col("v"), w) for w in (3, 9, 20)}, n=sl.rows(width=9))
    for r in out.collect():
        for w in (3, 9, 20):
            inside = [float(t % 5) for t in range(max(0, r.ts - w), r.ts + 1) if t % 7]
            assert r[f"s{w}"] == (sum(inside) if inside else None)
        assert r.n == min(r.ts, 9) + 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_h0" in plan and "_h1" not in plan and "_h2" not in plan


def test_moves_are_counted_inside_the_frame_for_the_rows_asked_for(spark):
    """Books (no price) among trades, a trade without a price, NaN, ties in time; frames over several chunks."""
    rnd, rows, ts = random.Random(4), [], 0
    for i in range(300):
        ts += rnd.choice([0, 1, 4, 30])
        trade = rnd.random() < 0.8
        rows.append((rnd.choice(["a", None]), ts, i, rnd.choice([None, math.nan, 1.0, 2.0, 2.0, 3.0]) if trade else None, trade))
    df, trade = spark.createDataFrame(rows, "k string, ts long, id long, v double, trade boolean"), F.col("trade")
    up, down = sl.moves(F.col("v"), trade)
    above = lambda x, y: x != y and not math.isnan(y) and (math.isnan(x) or x > y)
    want = {}
    for k, ts, i, _, is_trade in rows:
        if not is_trade:
            frame = [r[3] for r in rows if r[0] == k and ts - 20 <= r[1] <= ts and r[4]]
            pairs = [(a, b) for a, b in zip(frame, frame[1:]) if a is not None and b is not None]
            want[i] = (sum(math.isnan(a) or math.isnan(b) or b > a for a, b in pairs), sum(above(a, b) and not math.isnan(a) for a, b in pairs), len(frame))
    for chunk in (20, 75, 10**6):
        got = sl.sliding(df, ["k"], "ts", 20, chunk, ["id"], ~trade, ["id"], up=up, down=down, n=sl.rows(trade))
        assert got.columns == ["id", "up", "down", "n"]
        assert {r.id: tuple(r[1:]) for r in got.collect()} == want, chunk
    assert any(u and d for u, d, _ in want.values())
    thin = sl.sliding(df, ["k"], "ts", 20, 75, None, ~trade, ["id"], n=sl.rows(trade))  # totals alone take the other way
    assert {r.id: r.n for r in thin.collect()} == {i: n for i, (_, _, n) in want.items()}


def test_trades_are_shuffled_once_to_the_books_they_answer(spark):
    from tickloom.operators import depth

    books = spark.createDataFrame([("x", "s", 5), ("x", "s", 9)], "exchange string, symbol string, ts_us long")
    trades = spark.createDataFrame([("x", "s", t, t, "buy", 1.0 + t % 3, 2.0) for t in range(9)],
                                   "exchange string, symbol string, ts_us long, trade_id long, side string, price double, quantity double")
    out = depth.asof_trades_to_books(books, trades, 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert [tuple(r)[2:5] + tuple(r)[10:] for r in sorted(out.collect())] == [(5, 5, 5, 0 + 3, 1), (9, 4, 4, 2, 1)]
