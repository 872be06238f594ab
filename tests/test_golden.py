"""Hand-built cases with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tickloom.functions import book as bk
from tickloom.functions import scalars as s
from tickloom.operators import book as b
from tickloom.operators import depth as dp
from tickloom.operators import derivatives as dv
from tickloom.operators import ingest as ing
from tickloom.operators import normalize as nz
from tickloom.operators import positions as ps
from tickloom.operators import venues as v

LV = "array<struct<price:double,quantity:double>>"


def one(df):
    return df.collect()[0]


def a_book(spark, bids, asks):
    return spark.createDataFrame([("x", "s", 1, 1, bids, asks)], f"exchange string, symbol string, seq long, ts_us long, bids {LV}, asks {LV}")


def quotes(spark, rows):
    return spark.createDataFrame(
        [(e, "BTC", i, i, bid, 1.0, ask, 1.0) for i, (e, bid, ask) in enumerate(rows)],
        "exchange string, symbol string, seq long, ts_us long, best_bid double, bid_qty double, best_ask double, ask_qty double")


@pytest.mark.parametrize("mode", ["snapshot", "continuous"])
def test_nbbo(spark, mode):
    q = quotes(spark, [("binance", 100.0, 101.0), ("okx", 100.5, 100.8), ("bybit", 99.8, 101.2)])
    row = v.nbbo(q, 1000, mode=mode).orderBy(F.desc("ts_us")).first()
    assert (row.best_bid, row.bid_exchange, row.best_ask, row.ask_exchange, row.num_exchanges) == (100.5, "okx", 100.8, "okx", 3)
    assert row.mid == pytest.approx(100.65) and row.spread == pytest.approx(0.3) and row.spread_bps > 0


@pytest.mark.parametrize("mode", ["snapshot", "continuous"])
def test_nbbo_takes_every_venue(spark, mode):
    q = quotes(spark, [("kraken", 99.0, 99.5), ("okx", 90.0, 110.0)])
    row = v.nbbo(q, 1000, mode=mode).orderBy(F.desc("ts_us")).first()
    assert (row.best_bid, row.bid_exchange, row.num_exchanges) == (99.0, "kraken", 2)
    assert v.nbbo(q.limit(0), 1000, mode=mode).count() == 0


def test_nbbo_crossed(spark):
    row = v.nbbo(quotes(spark, [("okx", 101.0, 102.0), ("binance", 99.0, 100.0)]), 1000).orderBy(F.desc("ts_us")).first()
    assert row.is_crossed and row.arbitrage_profit == 1.0


def test_arbitrage(spark):
    base = [("binance", 50000.0, 50010.0), ("bybit", 50005.0, 50015.0), ("upbit", 49998.0, 50008.0), ("okx", 50002.0, 50012.0)]
    assert v.arbitrage_pairs(quotes(spark, base)).count() == 0
    base[1] = ("bybit", 50009.0, 50015.0)
    row = one(v.arbitrage_pairs(quotes(spark, base)))
    assert (row.sell_venue, row.buy_venue, row.ask) == ("bybit", "upbit", 50008.0)


def test_imbalances(spark):
    book = a_book(spark, [(100.0, 10.0), (99.0, 5.0)], [(101.0, 3.0)])
    assert one(dp.liquidity_imbalance_qty(book, 200)).liquidity_imbalance == pytest.approx(12 / 18)
    best = a_book(spark, [(100.0, 10.0)], [(101.0, 5.0)])
    assert one(dp.book_imbalance(best)).book_imbalance == pytest.approx(1 / 3)
    flow = one(dp.top_of_book(dp.book_imbalance(a_book(spark, [(100.0, 10.0), (99.0, 5.0)], [(101.0, 8.0), (102.0, 3.0)]))))
    assert flow.spread == 1 and flow.book_imbalance == pytest.approx(2 / 18)
    empty = a_book(spark, [], [(101.0, 1.0)])
    assert one(dp.wap_depth(empty)).wap is None and one(dp.book_imbalance(empty)).book_imbalance is None


def test_scaling(spark):
    cases = {"95123.45": 9512345000000, "0.00000123": 123, "1.123456789": 112345678, "100": 10000000000, "-1.5": -150000000,
             "1.2.3": None, "abc": None, "": None, "99999999999999999999": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in df.select("t", s.parse_scaled(F.col("t"), 8).alias("x")).collect()} == cases


def test_timestamps(spark):
    df = spark.createDataFrame([("Upbit", 1617720181), ("Deribit", 1617720181234567), ("Binance", 1617720181234)], "exchange string, timestamp long")
    assert [r.ts_ms for r in nz.normalize_ts(df).collect()] == [1617720181000, 1617720181234, 1617720181234]
    seq = spark.createDataFrame([(134456049,)], "timestamp long")
    assert one(nz.classify_ts(seq, F.lit(1617720181234).cast("long"))).is_timestamp is False


def updates(spark, rows):
    return spark.createDataFrame(rows, "exchange string, symbol string, seq long, update_id long, first_update_id long, prev_update_id long, is_snapshot boolean, ts_us long")


def test_gaps(spark):
    df = updates(spark, [("x", "s", 1, 100, 100, None, True, 1), ("x", "s", 2, 101, 101, 100, False, 2), ("x", "s", 3, 105, 102, 101, False, 3),
                         ("x", "s", 4, 110, 108, 105, False, 4)])
    got = {r.seq: (r.has_gap, r.missing) for r in b.seq_gaps(df, 2).collect()}
    assert got == {1: (False, 0), 2: (False, 0), 3: (False, 0), 4: (True, 2)}


def test_snapshot_sync(spark):
    snaps = spark.createDataFrame([("x", "s", 1, 100)], "exchange string, symbol string, seq long, last_update_id long")
    deltas = updates(spark, [("x", "s", 2, 99, 90, 89, False, 1), ("x", "s", 3, 105, 95, 99, False, 1), ("x", "s", 4, 110, 106, 105, False, 1),
                             ("x", "s", 5, 120, 115, 114, False, 1), ("x", "s", 6, 121, 121, 120, False, 1)])
    got = [r.verdict for r in b.snapshot_delta_sync(snaps, deltas, 3).orderBy("seq").collect()]
    assert got == ["stale", "accepted", "accepted", "resync", "rejected"]


def test_l3(spark):
    def row(seq, q, snap=False):
        return ("x", "s", seq, seq * 10, seq, snap, "bid", 100, 1.0, q)

    df = spark.createDataFrame(
        [("x", "s", 0, 0, 0, True, "ask", 200, 2.0, 5.0), row(1, 10.0), row(2, 14.0), row(3, 9.0), row(4, 0.0), row(5, 0.0),
         ("x", "s", 6, 60, 6, True, "ask", 201, 2.01, 1.0)],
        "exchange string, symbol string, seq long, ts_us long, update_id long, is_snapshot boolean, side string, price_ticks long, price double, quantity double")
    got = [(r.seq, r.side, r.event_type, r.quantity) for r in b.l3_events(df, 2).orderBy("order_id").collect()]
    assert got == [(0, "ask", "add", 5.0), (1, "bid", "add", 10.0), (2, "bid", "add", 4.0), (3, "bid", "execute", 5.0), (4, "bid", "cancel", 9.0),
                   (6, "ask", "cancel", 5.0), (6, "ask", "add", 1.0)]


def test_delta_before_snapshot_is_ignored(spark):
    df = spark.createDataFrame(
        [("x", "s", 1, 1, 1, False, "bid", 100, 1.0, 5.0), ("x", "s", 2, 2, 2, True, "bid", 101, 1.01, 7.0)],
        "exchange string, symbol string, seq long, ts_us long, update_id long, is_snapshot boolean, side string, price_ticks long, price double, quantity double")
    got = b.books(df, 10).collect()
    assert [(r.seq, [(x.price, x.quantity) for x in r.bids]) for r in got] == [(2, [(1.01, 7.0)])]


def test_emptied_book_keeps_its_row(spark):
    rows = [("x", "s", 1, 1, 1, False, "bid", 99, 0.99, 5.0), ("x", "s", 2, 2, 2, True, "bid", 100, 1.0, 5.0), ("x", "s", 3, 3, 3, False, "bid", 100, 1.0, 0.0),
            ("x", "s", 4, 4, 4, False, "ask", 101, 1.01, 2.0), ("x", "s", 5, 5, 5, True, "ask", 101, 1.01, 0.0)]
    df = spark.createDataFrame(rows, "exchange string, symbol string, seq long, ts_us long, update_id long, is_snapshot boolean, side string, price_ticks long, price double, quantity double")
    got = {r.seq: (len(r.bids), len(r.asks), r.best_bid, r.mid) for r in dp.top_of_book(b.books(df, 2)).collect()}
    assert got == {2: (1, 0, 1.0, None), 3: (0, 0, None, None), 4: (0, 1, None, None), 5: (0, 0, None, None)}
    sums = {r.seq: r.checksum for r in b.book_checksum(b.books(df, 2)).collect()}
    assert set(sums) == {2, 3, 4, 5} and sums[3] == sums[5] == "00000000"


def test_checksum_audit(spark):
    df = spark.createDataFrame([("x", "s", 1, "a", "a"), ("x", "s", 2, "a", "b")], "exchange string, symbol string, seq long, computed string, received string")
    last = b.checksum_audit(df, 10).orderBy(F.desc("seq")).first()
    assert last.success_rate == 0.5 and last.consecutive_failures == 1 and not last.needs_resync


def test_crc32_text(spark):
    import zlib

    book = a_book(spark, [(100.5, 1.25), (100.0, 2.0)], [(101.0, 3.0)])
    want = f"{zlib.crc32(b'100.5:1.25:101:3:100:2'):08x}"
    assert one(b.book_checksum(book, "crc32")).checksum == want
    assert one(book.select(bk.plain_number(F.lit(0.1)).alias("t"))).t == "0.1"


def test_positions_flip_and_close(spark):
    df = spark.createDataFrame(
        [("x", "s", i, side, q, p) for i, (side, q, p) in enumerate([("buy", 10.0, 100.0), ("buy", 10.0, 110.0), ("sell", 5.0, 120.0), ("sell", 25.0, 90.0), ("buy", 10.0, 80.0)])],
        "exchange string, symbol string, ts_us long, side string, quantity double, price double")
    for chunk in (1, 2, 100):
        row = one(ps.positions(df, ["ts_us"], chunk))
        # avg 105; +75 on 5; -225 on 15, short 10 at 90; +100 on closing
        assert (row.quantity, row.avg_price) == (0.0, 0.0) and row.realised_pnl == pytest.approx(75 - 225 + 100)


def test_instrument_codes(spark):
    df = spark.createDataFrame([("futures", "101RC000"), ("options", "201RC240"), ("options", "305AC100"), ("futures", "10")], "asset string, code string")
    got = {r.code: (r.underlying, r.month, r.option_type, r.strike_price) for r in dv.parse_instrument_code(df).collect()}
    assert got["101RC000"] == ("KOSPI200", "06", None, None) and got["201RC240"] == ("KOSPI200", "06", "Call", 600.0)
    assert got["305AC100"] == ("KQ150", "01", "Put", 100.0) and got["10"] == (None, None, None, None)


def test_moneyness_order(spark):
    df = spark.createDataFrame([(101.0, 100.0), (99.0, 100.0), (90.0, 100.0), (1.0, 0.0)], "spot_price double, strike_price double")
    assert [r.classification for r in dv.moneyness(df).collect()] == ["ITM", "ATM", "OTM", None]


def test_bad_messages_are_dropped(spark):
    df = spark.createDataFrame([("binance", "spot", 5, t) for t in ('{"broken', '{"result":null,"id":1}', '{"e":"trade","s":"","p":"1","q":"1"}', "[]")],
                               "exchange string, asset_type string, recv_ms long, payload string")
    assert ing.normalize_binance(df).count() == 0
    for fn in (ing.normalize_bybit, ing.normalize_okx, ing.normalize_coinbase, ing.normalize_deribit, ing.normalize_upbit, ing.normalize_bithumb, ing.normalize_ls):
        assert fn(df).count() == 0
