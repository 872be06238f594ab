"""Path-dependent operators against plain Python folds, and streams against batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import book as b
from tickloom.operators import ingest as ing
from tickloom.plans.ordered import chunk_of
from tickloom.streaming import jobs

LEVELS = "exchange string, symbol string, seq long, ts_us long, update_id long, is_snapshot boolean, side string, price_ticks long, price double, quantity double"


def level_rows(seed: int, n: int = 150):
    rnd, out = random.Random(seed), []
    for key in ("hot", "cold"):
        for seq in range(n if key == "hot" else n // 5):
            snap = rnd.random() < 0.05
            for side, base in (("bid", 100), ("ask", 130)):
                for tick in rnd.sample(range(base, base + 25), rnd.randint(0, 6)):
                    q = 0.0 if rnd.random() < 0.3 and not snap else float(rnd.randint(1, 9))
                    out.append((key, "s", seq, seq * 1000, seq, snap, side, tick, tick / 100, q))
    return out


def fold(rows):
    """Books after each message, one dict per (key, seq)."""
    books, held, live = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[2])):
        key, seq = r[0], r[2]
        state = held.setdefault(key, {"seq": None, "levels": {}})
        if state["seq"] != seq:
            state["seq"] = seq
            if r[5]:
                state["levels"], live[key] = {}, True
        if live.get(key):
            if r[9] == 0:
                state["levels"].pop((r[6], r[7]), None)
            else:
                state["levels"][(r[6], r[7])] = r[9]
            books[(key, seq)] = dict(state["levels"])
    return books


@pytest.mark.parametrize("seed,chunk", [(1, 7), (2, 40), (3, 1000)])
def test_books_equal_fold(spark, seed, chunk):
    rows = level_rows(seed)
    got = {}
    for r in b.books(spark.createDataFrame(rows, LEVELS), chunk).collect():
        got[(r.exchange, r.seq)] = {("bid", round(x.price * 100)): x.quantity for x in r.bids} | {("ask", round(x.price * 100)): x.quantity for x in r.asks}
        assert [x.price for x in r.bids] == sorted([x.price for x in r.bids], reverse=True)
        assert [x.price for x in r.asks] == sorted(x.price for x in r.asks)
    assert got == {k: v for k, v in fold(rows).items() if v}


def test_l3_telescopes(spark):
    """Adds less executes and cancels of a level give its quantity at the end."""
    rows = level_rows(4)
    net = {}
    for r in b.l3_events(spark.createDataFrame(rows, LEVELS), 20).collect():
        k = (r.exchange, r.side, r.price_ticks)
        net[k] = net.get(k, 0) + (r.quantity if r.event_type == "add" else -r.quantity)
    books = fold(rows)
    want = {}
    for key in ("hot", "cold"):
        last = max((s for k, s in books if k == key), default=None)
        if last is not None:
            want |= {(key, side, tick): q for (side, tick), q in books[(key, last)].items()}
    assert {k: v for k, v in net.items() if v} == want


def test_fixed_depth_forgets(spark):
    rows, depth = level_rows(5), 4
    got = {(r.exchange, r.side, r.seq): (r.levels, r.best_ticks, r.quantity) for r in b.fixed_depth_book(spark.createDataFrame(rows, LEVELS), 30, depth).collect()}
    held, live, seen, want = {}, set(), {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[6], r[7])):
        key, seq, side, tick, q = r[0], r[2], r[6], r[7], r[9]
        if r[5] and seen.get(key) != seq:
            held[key, "bid"], held[key, "ask"] = {}, {}
            live.add(key)
        seen[key] = seq
        if key not in live:
            continue
        side_book = held[key, side]
        if q == 0:
            side_book.pop(tick, None)
        else:
            side_book[tick] = q
            if len(side_book) > depth:
                side_book.pop(min(side_book) if side == "bid" else max(side_book))
        best = (max(side_book) if side == "bid" else min(side_book)) if side_book else None
        want[key, side, seq] = (len(side_book), best, sum(side_book.values()))
    assert got == want


def sides(seed, n=300):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.8 else "cold", "s", i, rnd.choice(["bid", "ask"]), rnd.random() < 0.5, [i]) for i in range(n)]


SIDES = "exchange string, symbol string, seq long, side string, is_last boolean, levels array<long>"


def merged(rows):
    held, out = {}, []
    for key, sym, seq, side, last, levels in rows:
        h = held.setdefault(key, {})
        h[side] = levels
        if last and len(h) == 2:
            out.append((key, sym, seq, h["bid"], h["ask"]))
            held[key] = {}
    return sorted(out)


@pytest.mark.parametrize("chunk", [10, 1000])
def test_merge_book_sides(spark, chunk):
    rows = sides(6)
    got = ing.merge_book_sides(spark.createDataFrame(rows, SIDES), chunk_of("seq", chunk))
    assert sorted((r.exchange, r.symbol, r.seq, r.bids, r.asks) for r in got.collect()) == merged(rows)


def test_stream_state_survives_batches(spark, tmp_path):
    """Three files, one per micro-batch: the keyed state must carry over."""
    rows = sides(7)
    for i in range(3):
        part = spark.createDataFrame(rows[i * 100:(i + 1) * 100], SIDES).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SIDES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.run_available_now(spark, jobs.stream_merge_book_sides(stream), "t")
    assert sorted((r.exchange, r.symbol, r.seq, r.bids, r.asks) for r in got.collect()) == merged(rows)


def test_builder_stream_equals_batch_when_live(spark, tmp_path):
    rows = [r for r in level_rows(8) if r[0] == "hot"]
    have = {r[2] for r in rows}
    df = spark.createDataFrame(rows, LEVELS).withColumn("pos", F.col("price_ticks"))
    df.coalesce(1).write.parquet(str(tmp_path / "lv"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "lv"))
    got = {r.seq: r for r in jobs.run_available_now(spark, jobs.stream_book_builder(stream, 10**6), "b").collect()}
    assert set(got) == have
    books = fold(rows)
    for seq, r in got.items():
        if r.state == "live":
            bids = [t for s, t in books[("hot", seq)] if s == "bid"]
            assert (r.best_bid_ticks, r.levels) == (max(bids, default=None), len(books[("hot", seq)]))


def test_restore_replays_to_the_last_book(spark):
    rows = level_rows(9)
    df = spark.createDataFrame(rows, LEVELS)
    snaps = b.book_snapshots(df, 25, every=20, keep=3)
    assert snaps.groupBy("exchange").count().filter("count > 3").count() == 0
    books = fold(rows)
    held, cleared = {}, None
    for r in sorted(b.restore_from_snapshots(snaps, df).filter("exchange = 'hot'").collect(), key=lambda r: r.seq):
        level = (r.side, round(r.price * 100))
        if r.is_snapshot and r.seq != cleared:
            held, cleared = {}, r.seq
        if r.quantity == 0:
            held.pop(level, None)
        else:
            held[level] = r.quantity
    assert held == books[("hot", max(s for k, s in books if k == "hot"))]
