"""Depth and feature queries over the book after every message."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import query
from tickloom.catalog.book import BOOK, CHUNK, L3, levels, stored_levels
from tickloom.operators import book as b
from tickloom.operators import depth as dp
from tickloom.operators.replay import replayed
from tickloom.sources.fixtures import _DUCK, view

ID = ["exchange", "symbol", "seq"]
DAY = 86_400_000_000


def books(spark, d, **measures):
    return replayed(levels(spark, d), CHUNK, **measures)


def w(name: str, alias: str | None = None):
    """Prices averaged over small volumes often end in a 5; step off the tie before rounding."""
    return F.round(F.col(name) + 1e-9, 6).alias(alias or name)


def r(*names: str, digits: int = 8):
    return [F.round(n, digits).alias(n) for n in names]


TOP = """, tp AS (
  SELECT exchange, symbol, seq, ts_us, max(price) FILTER (side = 'bid') AS bb, max(quantity) FILTER (side = 'bid' AND rk = 1) AS bq,
         min(price) FILTER (side = 'ask') AS ba, max(quantity) FILTER (side = 'ask' AND rk = 1) AS aq
  FROM lv GROUP BY ALL)"""

# Sums inside 10 and 20 bps of the mid, by side, for every book.
BAND = TOP + """, bd AS (
  SELECT t.*, (bb + ba) / 2 AS mid, l.side, l.price, l.quantity, l.rk,
         CASE l.side WHEN 'bid' THEN (bb + ba) / 2 - l.price ELSE l.price - (bb + ba) / 2 END AS away
  FROM tp t JOIN lv l ON t.exchange = l.exchange AND t.symbol = l.symbol AND t.seq = l.seq),
ag AS (
  SELECT exchange, symbol, seq, ts_us, bb, ba, bq, aq, mid,
    coalesce(sum(quantity) FILTER (side = 'bid' AND away <= mid * 10.0 / 10000), 0) AS b10,
    coalesce(sum(quantity) FILTER (side = 'ask' AND away <= mid * 10.0 / 10000), 0) AS a10,
    coalesce(sum(quantity) FILTER (side = 'bid' AND away <= mid * 20.0 / 10000), 0) AS b20,
    coalesce(sum(quantity) FILTER (side = 'ask' AND away <= mid * 20.0 / 10000), 0) AS a20,
    coalesce(sum(price * quantity) FILTER (away <= mid * 10.0 / 10000), 0) AS v10,
    coalesce(sum(price * quantity) FILTER (side = 'bid' AND away <= mid * 20.0 / 10000), 0) AS nb20,
    coalesce(sum(price * quantity) FILTER (side = 'ask' AND away <= mid * 20.0 / 10000), 0) AS na20,
    count(*) FILTER (side = 'bid') AS nb, count(*) FILTER (side = 'ask') AS na,
    coalesce(sum(quantity) FILTER (side = 'bid' AND rk <= 5), 0) AS b5, coalesce(sum(quantity) FILTER (side = 'ask' AND rk <= 5), 0) AS a5,
    coalesce(sum(quantity * (1.0::DOUBLE / rk)) FILTER (side = 'bid' AND rk <= 5), 0) AS wb,
    coalesce(sum(quantity * (1.0::DOUBLE / rk)) FILTER (side = 'ask' AND rk <= 5), 0) AS wa,
    coalesce(sum(quantity / abs(price - mid)) FILTER (side = 'bid' AND rk <= 10 AND price <> mid), 0) AS pb,
    coalesce(sum(quantity / abs(price - mid)) FILTER (side = 'ask' AND rk <= 10 AND price <> mid), 0) AS pa
  FROM bd GROUP BY ALL),
wp AS (SELECT *, CASE WHEN mid IS NOT NULL AND b10 + a10 > 0 THEN v10 / (b10 + a10) END AS wap FROM ag)"""


def _imb(x: str, y: str) -> str:
    return f"round(({x} - {y}) / nullif({x} + {y}, 0), 8)"


def _sql(body: str, src: str = "wp") -> str:
    return BOOK + BAND + f"\nSELECT exchange, symbol, seq, {body} FROM {src}"


@query("top_of_book", _sql("bb AS best_bid, bq AS bid_qty, ba AS best_ask, aq AS ask_qty, round(mid, 6) AS mid,"
                           " round(ba - bb, 6) AS spread, round((ba - bb) / mid * 10000, 6) AS spread_bps"))
def _(spark, d):
    out = dp.top_of_book(books(spark, d))
    return out.select(*ID, "best_bid", "bid_qty", "best_ask", "ask_qty", *r("mid", "spread", "spread_bps", digits=6))


@query("truncate_depth", BOOK + """
SELECT exchange, symbol, seq, count(*) FILTER (side = 'bid') AS bid_levels, count(*) FILTER (side = 'ask') AS ask_levels,
       coalesce(sum(quantity) FILTER (side = 'bid'), 0) AS bid_qty, coalesce(sum(quantity) FILTER (side = 'ask'), 0) AS ask_qty
FROM (SELECT * EXCLUDE (keep) FROM (SELECT *, rk <= 10 AS keep FROM lv) WHERE keep) GROUP BY ALL""")
def _(spark, d):
    from tickloom.catalog.book import summary

    return summary(dp.truncate_depth(books(spark, d, depth=10), 10))


@query("top_levels", BOOK + "SELECT exchange, symbol, seq, side, rk AS rank, price, quantity FROM lv WHERE rk <= 3 AND side IS NOT NULL")
def _(spark, d):
    return dp.top_levels(books(spark, d, depth=3), 3)


@query("wap_depth", _sql("round(wap + 1e-9, 6) AS wap"))
def _(spark, d):
    return dp.wap_depth(books(spark, d, bands=(10,)), 10).select(*ID, w("wap"))


@query("volume_at_depth", _sql(
    "CASE WHEN mid IS NULL THEN 0 ELSE b10 END AS bid_volume_10bps, CASE WHEN mid IS NULL THEN 0 ELSE a10 END AS ask_volume_10bps,"
    " CASE WHEN mid IS NULL THEN 0 ELSE b20 END AS bid_volume_20bps, CASE WHEN mid IS NULL THEN 0 ELSE a20 END AS ask_volume_20bps"))
def _(spark, d):
    out = dp.volume_at_depth(books(spark, d, bands=(10, 20)))
    return out.select(*ID, "bid_volume_10bps", "ask_volume_10bps", "bid_volume_20bps", "ask_volume_20bps")


@query("book_imbalance", _sql(_imb("bq", "aq") + " AS book_imbalance"))
def _(spark, d):
    return dp.book_imbalance(books(spark, d)).select(*ID, *r("book_imbalance"))


@query("liquidity_imbalance_qty", _sql(f"CASE WHEN mid IS NOT NULL THEN {_imb('b10', 'a10')} END AS liquidity_imbalance"))
def _(spark, d):
    return dp.liquidity_imbalance_qty(books(spark, d, bands=(10,))).select(*ID, *r("liquidity_imbalance"))


@query("liquidity_imbalance_notional", _sql(f"CASE WHEN mid IS NOT NULL THEN {_imb('nb20', 'na20')} END AS liquidity_imbalance"))
def _(spark, d):
    return dp.liquidity_imbalance_notional(books(spark, d, bands=(20,))).select(*ID, *r("liquidity_imbalance"))


@query("queue_imbalance_levels", _sql(_imb("nb", "na") + " AS queue_imbalance"))
def _(spark, d):
    return dp.queue_imbalance_levels(books(spark, d)).select(*ID, *r("queue_imbalance"))


@query("queue_imbalance_top5", _sql(_imb("b5", "a5") + " AS queue_imbalance"))
def _(spark, d):
    return dp.queue_imbalance_top5(books(spark, d, depth=5)).select(*ID, *r("queue_imbalance"))


@query("volume_weighted_imbalance", _sql(_imb("wb", "wa") + " AS volume_weighted_imbalance"))
def _(spark, d):
    return dp.volume_weighted_imbalance(books(spark, d, depth=5), 5).select(*ID, *r("volume_weighted_imbalance"))


@query("pressure_imbalance", _sql(f"CASE WHEN mid IS NOT NULL THEN {_imb('pb', 'pa')} END AS pressure_imbalance"))
def _(spark, d):
    return dp.pressure_imbalance(books(spark, d, depth=10)).select(*ID, *r("pressure_imbalance"))


LAGGED = BAND + "".join(f""", g{i} AS (
  SELECT a.exchange, a.symbol, a.seq, b.wap AS wap_lag{i} FROM wp a ASOF JOIN wp b ON a.exchange = b.exchange
   AND a.symbol = b.symbol AND a.ts_us - {i * DAY} >= b.ts_us)""" for i in (1, 2, 3))
LAGS_MS = tuple(i * DAY // 1000 for i in (1, 2, 3))


@query("asof_book_lag", BOOK + LAGGED + """
SELECT w.exchange, w.symbol, w.seq, round(w.wap + 1e-9, 6) AS wap, round(wap_lag1 + 1e-9, 6) AS wap_lag1,
       round(wap_lag2 + 1e-9, 6) AS wap_lag2, round(wap_lag3 + 1e-9, 6) AS wap_lag3
FROM wp w LEFT JOIN g1 USING (exchange, symbol, seq) LEFT JOIN g2 USING (exchange, symbol, seq)
LEFT JOIN g3 USING (exchange, symbol, seq)""")
def _(spark, d):
    thin = dp.wap_depth(books(spark, d, bands=(10,)), 10).select(*ID, "ts_us", "wap")
    out = dp.asof_book_lag(thin, LAGS_MS, ("wap",), 100 * DAY)
    return out.select(*ID, w("wap"), *[w(f"wap_{lag}ms", f"wap_lag{i + 1}") for i, lag in enumerate(LAGS_MS)])


@query("wap_momentum", BOOK + LAGGED + """
SELECT w.exchange, w.symbol, w.seq, round((w.wap - wap_lag3) / wap_lag3, 8) AS wap_momentum
FROM wp w LEFT JOIN g3 USING (exchange, symbol, seq)""")
def _(spark, d):
    return dp.wap_momentum(books(spark, d, bands=(10,)), LAGS_MS[2], 10, 100 * DAY).select(*ID, *r("wap_momentum"))


@query("wap_rolling_stats", BOOK + BAND + f""", s AS (
  SELECT exchange, symbol, seq, wap, avg(wap) OVER w AS m, stddev_pop(wap) OVER w AS sd, min(wap) OVER w AS lo,
         max(wap) OVER w AS hi, count(wap) OVER w AS n FROM wp
  WINDOW w AS (PARTITION BY exchange, symbol ORDER BY ts_us RANGE BETWEEN {20 * DAY} PRECEDING AND CURRENT ROW))
SELECT exchange, symbol, seq, round(m + 1e-9, 6) AS wap_mean, round(sd + 1e-9, 6) AS wap_std, round(lo + 1e-9, 6) AS wap_min,
       round(hi + 1e-9, 6) AS wap_max, n AS wap_count, round(CASE WHEN sd > 1e-9 THEN (wap - m) / sd END, 5) AS wap_zscore FROM s""")
def _(spark, d):
    out = dp.wap_rolling_stats(books(spark, d, bands=(10,)), 20 * DAY)
    return out.select(*ID, *[w(c) for c in ("wap_mean", "wap_std", "wap_min", "wap_max")], "wap_count", *r("wap_zscore", digits=5))


TRADES = f", fx_fills AS ({_DUCK['fx_fills']})" + """, td AS (
  SELECT *, sign(price - lag(price) OVER w) AS mv, row_number() OVER w AS rn FROM fx_fills
  WINDOW w AS (PARTITION BY exchange, symbol ORDER BY ts_us, l_orderkey, l_linenumber, l_partkey, l_suppkey))"""
WINDOW_US = 10 * DAY
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
FLOW = TRADES + f""", fl AS (
  SELECT w.exchange, w.symbol, w.seq, count(t.rn) AS n, min(t.rn) AS frn,
         count(*) FILTER (t.side = 'buy') AS nbuy, count(*) FILTER (t.side = 'sell') AS nsell,
         coalesce(sum(t.quantity) FILTER (t.side = 'buy'), 0) AS qbuy, coalesce(sum(t.quantity) FILTER (t.side = 'sell'), 0) AS qsell,
         coalesce(sum(t.price * t.quantity) FILTER (t.side = 'buy'), 0) AS vbuy,
         coalesce(sum(t.price * t.quantity) FILTER (t.side = 'sell'), 0) AS vsell,
         count(*) FILTER (t.mv > 0) AS nup, count(*) FILTER (t.mv < 0) AS ndown,
         arg_min(coalesce(t.mv, 0), t.rn) AS fmv
  FROM tp w LEFT JOIN td t ON w.exchange = t.exchange AND w.symbol = t.symbol
   AND t.ts_us BETWEEN w.ts_us - {WINDOW_US} AND w.ts_us GROUP BY ALL),
fw AS (SELECT *, nup - coalesce((fmv > 0)::INT, 0) AS up_moves, ndown - coalesce((fmv < 0)::INT, 0) AS down_moves FROM fl)"""


def trades(spark, d):
    return view(spark, d, "fx_fills")


@query("asof_trades_to_books", BOOK + TOP + FLOW + """
SELECT exchange, symbol, seq, n AS trades, nbuy AS buys, nsell AS sells, qbuy AS buy_qty, qsell AS sell_qty,
       round(vbuy, 4) AS buy_notional, round(vsell, 4) AS sell_notional, up_moves, down_moves FROM fw""")
def _(spark, d):
    thin = replayed(stored_levels(spark, d), CHUNK).select(*ID, "ts_us")
    out = dp.asof_trades_to_books(thin, trades(spark, d), WINDOW_US, ORDER)
    return out.select(
        *ID, "trades", "buys", "sells", "buy_qty", "sell_qty", *r("buy_notional", "sell_notional", digits=4),
        "up_moves", "down_moves",
    )


VEC = ["wap_0ms", "wap_lag1", "wap_lag2", "wap_lag3", "order_flow_imbalance", "order_book_imbalance",
       "liquidity_imbalance", "queue_imbalance", "tick_flow_imbalance", "trade_flow_imbalance", "spread", "spread_bps",
       "bid_volume_10bps", "ask_volume_10bps", "bid_volume_20bps", "ask_volume_20bps"]


def _vec(ofi: str, liq: str, queue: str, tick: str, flow: str) -> str:
    return f"""
SELECT w.exchange, w.symbol, w.seq, round(w.wap + 1e-9, 6) AS wap_0ms, round(wap_lag1 + 1e-9, 6) AS wap_lag1,
  round(wap_lag2 + 1e-9, 6) AS wap_lag2, round(wap_lag3 + 1e-9, 6) AS wap_lag3, {ofi} AS order_flow_imbalance, round({_imb('bq', 'aq')}, 6) AS order_book_imbalance,
  CASE WHEN mid IS NOT NULL THEN round({liq}, 6) END AS liquidity_imbalance, round({queue}, 6) AS queue_imbalance,
  round({tick}, 6) AS tick_flow_imbalance, round({flow}, 6) AS trade_flow_imbalance, round(ba - bb, 6) AS spread,
  round((ba - bb) / mid * 10000, 6) AS spread_bps,
  CASE WHEN mid IS NULL THEN 0 ELSE b10 END AS bid_volume_10bps, CASE WHEN mid IS NULL THEN 0 ELSE a10 END AS ask_volume_10bps,
  CASE WHEN mid IS NULL THEN 0 ELSE b20 END AS bid_volume_20bps, CASE WHEN mid IS NULL THEN 0 ELSE a20 END AS ask_volume_20bps
FROM wp w JOIN fw USING (exchange, symbol, seq) LEFT JOIN g1 USING (exchange, symbol, seq)
LEFT JOIN g2 USING (exchange, symbol, seq) LEFT JOIN g3 USING (exchange, symbol, seq)"""


def _raw(x: str, y: str) -> str:
    return f"({x} - {y})::DOUBLE / nullif({x} + {y}, 0)"


OFI = L3 + f""", pe AS (
  SELECT exchange, symbol, seq, ts_us, coalesce(sum(quantity) FILTER (event_type = 'add' AND side = 'bid'), 0) AS buy,
         coalesce(sum(quantity) FILTER (event_type = 'add' AND side = 'ask'), 0) AS sell FROM xe GROUP BY ALL),
of AS (SELECT exchange, symbol, seq, (sum(buy) OVER w - sum(sell) OVER w) / nullif(sum(buy) OVER w + sum(sell) OVER w, 0) AS ofi
  FROM pe WINDOW w AS (PARTITION BY exchange, symbol ORDER BY ts_us RANGE BETWEEN {WINDOW_US} PRECEDING AND CURRENT ROW))"""

LOOKBACK = (BOOK + LAGGED + FLOW + OFI
            + _vec("round(ofi, 6)", _raw("b10", "a10"), _raw("nb", "na"), _raw("nbuy", "nsell"), _raw("qbuy", "qsell"))
            + " LEFT JOIN of USING (exchange, symbol, seq)").replace(f"round({_imb('bq', 'aq')}, 6)", f"round({_raw('bq', 'aq')}, 6)")
ENGINE = (BOOK + LAGGED + FLOW
          + _vec(f"round({_raw('vbuy', 'vsell')}, 6)", _raw("nb20", "na20"), _raw("b5", "a5"), _raw("up_moves", "down_moves"),
                 _raw("vbuy", "vsell"))).replace(f"round({_imb('bq', 'aq')}, 6)", f"round({_raw('bq', 'aq')}, 6)")


def lookback(spark, d):
    lv = stored_levels(spark, d)
    flow = b.order_flow_imbalance_l3(b.l3_events(lv, CHUNK), WINDOW_US // 1000)
    return dp.features(replayed(lv, CHUNK, **dp.NEEDS), trades(spark, d), flow, "lookback", WINDOW_US, LAGS_MS, ORDER, 100 * DAY)


def engine(spark, d):
    return dp.features(replayed(stored_levels(spark, d), CHUNK, **dp.NEEDS), trades(spark, d), None, "engine", WINDOW_US, LAGS_MS, ORDER, 100 * DAY)


@query("features", LOOKBACK)
def _(spark, d):
    return lookback(spark, d).select(*ID, *[w(v) for v in VEC[:4]], *r(*VEC[4:], digits=6))


@query("features_engine", ENGINE)
def _(spark, d):
    return engine(spark, d).select(*ID, *[w(v) for v in VEC[:4]], *r(*VEC[4:], digits=6))


@query("signals", BOOK + TOP + FLOW + f""", s AS (SELECT exchange, symbol, seq, {_raw('vbuy', 'vsell')} AS ofi FROM fw)
SELECT exchange, symbol, seq, CASE WHEN ofi > 0 THEN 'Momentum' ELSE 'MeanReversion' END AS signal_type,
       round(abs(ofi), 8) AS strength, 0.7::DOUBLE AS confidence,
       CASE WHEN abs(ofi) > 0.5 THEN CASE WHEN ofi > 0 THEN 'buy' ELSE 'sell' END END AS order_side
FROM s WHERE abs(ofi) > 0.3""")
def _(spark, d):
    out = dp.signals(engine(spark, d))
    return out.select(*ID, "signal_type", *r("strength"), "confidence", "order_side")
