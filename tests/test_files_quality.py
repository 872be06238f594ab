"""Published file layout, restored books, and causes of inversions on known streams."""

from __future__ import annotations

import gzip
import os

import pytest

from tests.test_folds import LEVELS, fold, level_rows
from tickloom.operators import book as b
from tickloom.operators import quality as q
from tickloom.operators.normalize import normalize_ts
from tickloom.sources import files


def put(base, folder, symbol, date, text):
    os.makedirs(f"{base}/{folder}/{symbol}", exist_ok=True)
    with gzip.open(f"{base}/{folder}/{symbol}/{date}_{symbol}.csv.gz", "wt") as f:
        f.write(text)


def test_history_by_symbol_and_date(spark, tmp_path):
    base = str(tmp_path)
    for symbol in ("BTCUSDT", "ETHUSDT"):
        for day in ("2025-07-01", "2025-07-02"):
            put(base, "incremental_book_L2", symbol, day, "timestamp,side,price,amount,is_snapshot\n5,bid,100.5,2,true\n5,ask,101,3,true\n6,bid,100.5,0,false\n")
            put(base, "trades", symbol, day, "timestamp,price,amount,side,id\n7,100,1,BUY,a\n8,100,2,,\n")
    rows = files.scan_l2_csv(spark, base).collect()
    assert len(rows) == 12 and {(r.symbol, r.date) for r in rows} == {(s, d) for s in ("BTCUSDT", "ETHUSDT") for d in ("2025-07-01", "2025-07-02")}
    some = files.scan_l2_csv(spark, base, ["ETHUSDT"], ["2025-07-02"])
    assert {(r.symbol, r.date) for r in some.collect()} == {("ETHUSDT", "2025-07-02")} and len(some.inputFiles()) == 1
    trades = files.scan_trades_csv(spark, base, ["BTCUSDT"]).orderBy("date", "timestamp").collect()
    assert [(r.side, r.id, r.amount) for r in trades] == [("buy", "a", 1.0), ("sell", "unknown", 2.0)] * 2


def test_restored_books_go_on_as_the_full_replay(spark):
    rows = level_rows(21)
    df = spark.createDataFrame(rows, LEVELS)
    snaps = b.book_snapshots(df, 25, every=20, keep=3)
    kept = {r.exchange: r.seq for r in snaps.groupBy("exchange").agg({"seq": "max"}).withColumnRenamed("max(seq)", "seq").collect()}
    books = {k: v for k, v in fold(rows).items() if k[0] in kept and k[1] >= kept[k[0]]}
    got = {(r.exchange, r.seq): {("bid", round(x.price * 100)): x.quantity for x in r.bids} | {("ask", round(x.price * 100)): x.quantity for x in r.asks}
           for r in b.restored_books(snaps, df, 25).collect()}
    assert got == books


def test_a_restored_empty_book(spark):
    rows = [("x", "s", i, i, i, i == 1, "bid", 100, 1.0, q) for i, q in ((1, 1.0), (2, 0.0), (3, 4.0))]
    df = spark.createDataFrame(rows, LEVELS)
    snaps = b.book_snapshots(df, 5, every=2)
    assert [(r.seq, [x.quantity for x in r.bids]) for r in b.restored_books(snaps, df, 5).orderBy("seq").collect()] == [(2, []), (3, [4.0])]


PACKETS = "exchange string, symbol string, event_id long, recv_ms long, exchange_ms long, sequence long"


def causes(spark, stream, chunk=3):
    """stream: (exchange, symbol, exchange_ms) in arrival order."""
    rows = [(e, s, i, i, ms, i) for i, (e, s, ms) in enumerate(stream)]
    return q.inversion_causes(spark.createDataFrame(rows, PACKETS), chunk).first()


def counted(stream):
    """The counters packet by packet."""
    last, last_key, run, consecutive, isolated = {}, None, 0, 0, 0
    for e, s, ms in stream:
        key = (e, s)
        if key in last:
            if ms < last[key]:
                if last_key == key:
                    consecutive, run = consecutive + 1, run + 1
                else:
                    isolated += run == 0
                    run = 0
                last_key = key
            elif last_key == key:
                run = 0
        last[key] = ms
    return consecutive, isolated


@pytest.mark.parametrize("seed", range(4))
def test_successions_equal_the_counters_packet_by_packet(spark, seed):
    import random

    rnd = random.Random(seed)
    stream = [(rnd.choice("ab"), rnd.choice("st"), rnd.randint(0, 5000)) for _ in range(300)]
    row = causes(spark, stream, rnd.choice([1, 7, 1000]))
    assert (row.consecutive, row.isolated) == counted(stream)


def test_each_cause(spark):
    up = [("a", "s", 10_000 + i) for i in range(3)]
    assert causes(spark, up).verdict == "clean"
    assert causes(spark, up + [("a", "s", 10_000), ("a", "s", 10_010), ("a", "s", 10_005)]).verdict == "network"
    assert causes(spark, up + [("a", "s", 1)]).verdict == "timestamps"
    assert causes(spark, up + [("a", "s", 9_900), ("a", "s", 9_800), ("a", "s", 9_700)]).verdict == "buffering"
    assert causes(spark, up + [("a", "s", 9_900)]).verdict == "single_venue"
    assert causes(spark, up + [("a", "s", 9_900), ("b", "s", 10_000), ("b", "s", 9_900)]).verdict == "mixed"


def test_venue_names_in_any_case(spark):
    df = spark.createDataFrame([("upbit", 1617720181), ("UPBIT", 1617720181), ("Upbit", 1617720181)], "exchange string, timestamp long")
    assert {r.ts_ms for r in normalize_ts(df).collect()} == {1617720181000}
