"""Cross-venue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import query
from tickloom.operators import venues as v
from tickloom.sources.fixtures import duck, view

# 2024-01-11 19:00 UTC, a point inside the event range at which two venues cross.
MID = 1_704_999_600_000_000
STALE_MS = 3_600_000

T, Q = duck("fx_trades"), duck("fx_quotes")
LAST_T = "l AS (SELECT symbol, exchange, arg_max(price, trade_id) AS price FROM fx_trades {where} GROUP BY ALL)"
LAST_Q = (
    "l AS (SELECT symbol, exchange, arg_max(best_bid, seq) AS bid, arg_max(best_ask, seq) AS ask "
    "FROM fx_quotes {where} GROUP BY ALL)"
)


def r8(name: str):
    return F.round(name, 8).alias(name)


@query("cross_exchange_pairs", T + "," + LAST_T.format(where="") + """
SELECT a.symbol, a.exchange AS exchange1, a.price AS price1, b.exchange AS exchange2, b.price AS price2,
       round(abs(a.price - b.price), 8) AS spread, round(abs(a.price - b.price) / a.price * 100, 8) AS spread_percent
FROM l a JOIN l b ON a.symbol = b.symbol AND a.exchange < b.exchange""")
def _(spark, d):
    out = v.cross_exchange_pairs(view(spark, d, "fx_trades"))
    return out.select("symbol", "exchange1", "price1", "exchange2", "price2", r8("spread"), r8("spread_percent"))


@query("cross_exchange_spread", Q + "," + LAST_Q.format(where="") + """
SELECT a.symbol, a.bid AS bid1, b.ask AS ask2, round(a.bid - b.ask, 8) AS spread
FROM l a JOIN l b ON a.symbol = b.symbol AND a.exchange = 'binance' AND b.exchange = 'okx'""")
def _(spark, d):
    out = v.cross_exchange_spread(view(spark, d, "fx_quotes"), "binance", "okx")
    return out.withColumn("spread", F.round("spread", 8))


@query("price_ratio", T + "," + LAST_T.format(where="") + """
SELECT a.symbol, a.price AS price1, b.price AS price2, round(a.price / b.price, 8) AS ratio
FROM l a JOIN l b ON a.symbol = b.symbol AND a.exchange = 'binance' AND b.exchange = 'bybit'""")
def _(spark, d):
    return v.price_ratio(view(spark, d, "fx_trades"), "binance", "bybit").withColumn("ratio", F.round("ratio", 8))


@query("latest_book_by_exchange", Q + """
SELECT * FROM (
  SELECT symbol, exchange, max(ts_us) AS ts_us, arg_max(best_bid, seq) AS best_bid, arg_max(bid_qty, seq) AS bid_qty,
         arg_max(best_ask, seq) AS best_ask, arg_max(ask_qty, seq) AS ask_qty,
         count(*) OVER (PARTITION BY symbol) AS venues FROM fx_quotes GROUP BY symbol, exchange) WHERE venues >= 2""")
def _(spark, d):
    return v.latest_book_by_exchange(view(spark, d, "fx_quotes"))


@query("arbitrage_pairs", Q + "," + LAST_Q.format(where=f"WHERE ts_us <= {MID}") + """
SELECT a.symbol, a.exchange AS sell_venue, a.bid, b.exchange AS buy_venue, b.ask, round(a.bid - b.ask, 8) AS spread
FROM l a JOIN l b ON a.symbol = b.symbol AND a.exchange <> b.exchange AND a.bid > b.ask""")
def _(spark, d):
    return v.arbitrage_pairs(view(spark, d, "fx_quotes"), MID).withColumn("spread", F.round("spread", 8))


@query("price_ratio_deviation", T + "," + LAST_T.format(where="") + """
SELECT b.symbol, b.exchange, b.price, a.price AS base_price, round(a.price / b.price, 8) AS ratio,
       round((a.price / b.price - 1) * 10000, 6) AS deviation_bps
FROM l a JOIN l b ON a.symbol = b.symbol AND a.exchange = 'binance' AND b.exchange <> 'binance'""")
def _(spark, d):
    out = v.price_ratio_deviation(view(spark, d, "fx_trades"), "binance")
    return out.select(
        "symbol", "exchange", "price", "base_price", r8("ratio"), F.round("deviation_bps", 6).alias("deviation_bps")
    )


@query("snapshot_spread_bps", duck("fx_base", "fx_quotes") + """
SELECT q.seq, q.exchange, q.symbol, round((best_ask - best_bid) / best_bid * 10000, 6) AS spread_bps,
       round((best_bid + best_ask) / 2, 6) AS mid, greatest((b.k - 20) * 1000, 0) AS latency_us
FROM fx_quotes q JOIN fx_base b ON q.seq = b.event_id""")
def _(spark, d):
    quotes = view(spark, d, "fx_quotes").withColumn(
        "local_ts_us", F.col("ts_us") + (F.col("bid_qty").cast("long") - 21) * 1000
    )
    out = v.snapshot_spread_bps(quotes)
    return out.select(
        "seq", "exchange", "symbol", F.round("spread_bps", 6).alias("spread_bps"), F.round("mid", 6).alias("mid"),
        "latency_us",
    )


NBBO_TAIL = """
SELECT {at} num_exchanges, num_checked, b.p AS best_bid, b.q AS bid_qty, b.x AS bid_exchange,
       a.p AS best_ask, a.q AS ask_qty, a.x AS ask_exchange, round((b.p + a.p) / 2, 6) AS mid,
       round(a.p - b.p, 6) AS spread, round((a.p - b.p) / ((b.p + a.p) / 2) * 10000, 6) AS spread_bps,
       round(num_exchanges / num_checked, 8) AS validation_rate, b.p >= a.p AS is_crossed, b.p = a.p AS is_locked,
       CASE WHEN b.p >= a.p THEN round(b.p - a.p, 6) ELSE 0.0 END AS arbitrage_profit
FROM {src} WHERE b IS NOT NULL AND a IS NOT NULL"""

CONT = f"""
f AS (
  SELECT q.symbol, q.seq, q.ts_us, c.exchange AS x, c.ts_us AS qts, c.best_bid AS bid, c.bid_qty, c.best_ask AS ask, c.ask_qty
  FROM fx_quotes q CROSS JOIN (SELECT DISTINCT exchange AS x FROM fx_quotes) AS e
  ASOF JOIN fx_quotes c ON q.symbol = c.symbol AND e.x = c.exchange AND q.seq >= c.seq),
n AS (
  SELECT symbol, seq, ts_us, count(*) AS num_checked, count(*) FILTER (ts_us - qts <= {STALE_MS * 1000}) AS num_exchanges,
         min(CASE WHEN ts_us - qts <= {STALE_MS * 1000} THEN {{'k': -bid, 'x': x, 'q': bid_qty, 'p': bid}} END) AS b,
         min(CASE WHEN ts_us - qts <= {STALE_MS * 1000} THEN {{'k': ask, 'x': x, 'q': ask_qty, 'p': ask}} END) AS a
  FROM f GROUP BY ALL)"""

COLS = [
    "num_exchanges", "num_checked", "best_bid", "bid_qty", "bid_exchange", "best_ask", "ask_qty", "ask_exchange",
]


def _derived():
    rounded = [F.round(c, 6).alias(c) for c in ("mid", "spread", "spread_bps", "arbitrage_profit")]
    return [*rounded, F.round("validation_rate", 8).alias("validation_rate"), "is_crossed", "is_locked"]


def _continuous(spark, d):
    return v.nbbo(view(spark, d, "fx_quotes"), STALE_MS)


@query("nbbo", Q + "," + CONT + NBBO_TAIL.format(at="symbol, ts_us, seq,", src="n"))
def _(spark, d):
    return _continuous(spark, d).select("symbol", "ts_us", "seq", *COLS, *_derived())


@query("nbbo_snapshot", Q + f""", l AS (
  SELECT symbol, exchange AS x, max(ts_us) AS ts, arg_max(best_bid, seq) AS bid, arg_max(bid_qty, seq) AS bid_qty,
         arg_max(best_ask, seq) AS ask, arg_max(ask_qty, seq) AS ask_qty FROM fx_quotes WHERE ts_us <= {MID} GROUP BY ALL),
n AS (
  SELECT symbol, count(*) AS num_checked, count(*) FILTER ({MID} - ts < 7201000000) AS num_exchanges,
         min(CASE WHEN {MID} - ts < 7201000000 THEN {{'k': -bid, 'x': x, 'q': bid_qty, 'p': bid}} END) AS b,
         min(CASE WHEN {MID} - ts < 7201000000 THEN {{'k': ask, 'x': x, 'q': ask_qty, 'p': ask}} END) AS a
  FROM l GROUP BY ALL)""" + NBBO_TAIL.format(at="symbol,", src="n"))
def _(spark, d):
    out = v.nbbo(view(spark, d, "fx_quotes"), 7_200_000, as_of=MID, mode="snapshot")
    return out.select("symbol", *COLS, *_derived())


@query("nbbo_statistics", Q + "," + CONT + """,
m AS (SELECT symbol, b.x AS bx, a.x AS ax, a.p - b.p AS spread, b.p >= a.p AS crossed, b.p = a.p AS locked,
             (a.p - b.p) / ((b.p + a.p) / 2) * 10000 AS bps FROM n WHERE b IS NOT NULL AND a IS NOT NULL),
t AS (SELECT count(DISTINCT symbol) AS symbols, count(*) AS computations, round(avg(bps), 6) AS avg_spread_bps,
             round(min(bps), 6) AS min_spread_bps, round(max(bps), 6) AS max_spread_bps,
             count(*) FILTER (locked) AS locked_markets, count(*) FILTER (crossed) AS crossed_markets,
             count(*) FILTER (spread < 0) AS negative_spreads FROM m),
s AS (SELECT venue, CAST(sum(b) AS BIGINT) AS best_bid_count, CAST(sum(a) AS BIGINT) AS best_ask_count FROM (
        SELECT bx AS venue, 1 AS b, 0 AS a FROM m UNION ALL SELECT ax, 0, 1 FROM m) GROUP BY venue)
SELECT s.*, t.*, round(best_bid_count / computations * 100, 6) AS best_bid_pct,
       round(best_ask_count / computations * 100, 6) AS best_ask_pct FROM s CROSS JOIN t""")
def _(spark, d):
    out = v.nbbo_statistics(_continuous(spark, d))
    return out.withColumns({
        c: F.round(c, 6)
        for c in ("avg_spread_bps", "min_spread_bps", "max_spread_bps", "best_bid_pct", "best_ask_pct")
    })


@query("stale_books", Q + f"""
SELECT exchange, symbol, last_ts_us, age_ms FROM (
  SELECT exchange, symbol, max(ts_us) AS last_ts_us,
         (max(max(ts_us)) OVER () - max(ts_us)) // 1000 AS age_ms FROM fx_quotes GROUP BY ALL)
WHERE age_ms > {STALE_MS}""")
def _(spark, d):
    return v.stale_books(view(spark, d, "fx_quotes"), STALE_MS)
