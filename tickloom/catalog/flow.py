"""Trade-flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import last_accepted, query
from tickloom.operators import flow
from tickloom.sources.fixtures import duck, view

HOUR = 3_600_000_000
FAST, SLOW = 6 * HOUR, 24 * HOUR
ID = ["trade_id", "exchange", "symbol", "ts_us"]


def _frame(width: int, name: str = "w", order: str = "ts_us") -> str:
    return (
        f"WINDOW {name} AS (PARTITION BY exchange, symbol ORDER BY {order} "
        f"RANGE BETWEEN {width} PRECEDING AND CURRENT ROW)"
    )


def _trades(spark, d):
    return view(spark, d, "fx_trades")


T = duck("fx_trades")


@query("tick_flow_by_side", T + f"""
SELECT trade_id, exchange, symbol, ts_us,
       round((count(*) FILTER (side = 'buy') OVER w - count(*) FILTER (side = 'sell') OVER w) / count(*) OVER w, 8)
         AS tick_flow_imbalance
FROM fx_trades {_frame(FAST)}""")
def _(spark, d):
    out = flow.tick_flow_by_side(_trades(spark, d), FAST)
    return out.select(*ID, F.round("tick_flow_imbalance", 8).alias("tick_flow_imbalance"))


@query("tick_flow_updown", T + f""", m AS (
  SELECT *, sign(price - lag(price) OVER (PARTITION BY exchange, symbol ORDER BY ts_us, trade_id)) AS mv,
         row_number() OVER (PARTITION BY exchange, symbol ORDER BY ts_us, trade_id) AS rn FROM fx_trades),
w AS (
  SELECT a.trade_id, a.exchange, a.symbol, a.ts_us, min(b.rn) AS first_rn FROM m a JOIN m b
    ON a.exchange = b.exchange AND a.symbol = b.symbol AND b.ts_us BETWEEN a.ts_us - {SLOW} AND a.ts_us
  GROUP BY ALL)
SELECT w.trade_id, w.exchange, w.symbol, w.ts_us,
       CAST(count(*) FILTER (b.mv > 0 AND b.rn > first_rn) AS DOUBLE) AS up,
       CAST(count(*) FILTER (b.mv < 0 AND b.rn > first_rn) AS DOUBLE) AS down,
       round((count(*) FILTER (b.mv > 0 AND b.rn > first_rn) - count(*) FILTER (b.mv < 0 AND b.rn > first_rn))
         / nullif(count(*) FILTER (b.mv <> 0 AND b.rn > first_rn), 0), 8) AS tick_flow_imbalance
FROM w JOIN m b ON w.exchange = b.exchange AND w.symbol = b.symbol AND b.ts_us BETWEEN w.ts_us - {SLOW} AND w.ts_us
GROUP BY ALL""")
def _(spark, d):
    out = flow.tick_flow_updown(_trades(spark, d), SLOW)
    return out.select(*ID, "up", "down", F.round("tick_flow_imbalance", 8).alias("tick_flow_imbalance"))


def _flow_sql(amount: str, width: int) -> str:
    return T + f"""
SELECT trade_id, exchange, symbol, ts_us,
       round((sum(CASE side WHEN 'buy' THEN {amount} ELSE 0 END) OVER w
              - sum(CASE side WHEN 'sell' THEN {amount} ELSE 0 END) OVER w) / sum({amount}) OVER w, 8)
         AS trade_flow_imbalance
FROM fx_trades {_frame(width)}"""


@query("trade_flow_qty", _flow_sql("quantity", FAST))
def _(spark, d):
    out = flow.trade_flow_qty(_trades(spark, d), FAST)
    return out.select(*ID, F.round("trade_flow_imbalance", 8).alias("trade_flow_imbalance"))


@query("trade_flow_notional", _flow_sql("price * quantity", SLOW))
def _(spark, d):
    out = flow.trade_flow_notional(_trades(spark, d), SLOW)
    return out.select(*ID, F.round("trade_flow_imbalance", 8).alias("trade_flow_imbalance"))


@query("order_flow_imbalance_trades", _flow_sql("price * quantity", SLOW).replace(
    "trade_flow_imbalance", "order_flow_imbalance"))
def _(spark, d):
    out = flow.order_flow_imbalance_trades(_trades(spark, d), SLOW)
    return out.select(*ID, F.round("order_flow_imbalance", 8).alias("order_flow_imbalance"))


@query("rolling_vwap", T + f"""
SELECT trade_id, exchange, symbol, ts_us, round(sum(price * quantity) OVER w / sum(quantity) OVER w + 1e-9, 6) AS vwap
FROM fx_trades {_frame(SLOW)}""")
def _(spark, d):
    return flow.rolling_vwap(_trades(spark, d), SLOW).select(*ID, F.round(F.col("vwap") + 1e-9, 6).alias("vwap"))


@query("trade_intensity", T + f"""
SELECT trade_id, exchange, symbol, ts_us, round(count(*) OVER w / {SLOW / 1e6}, 10) AS trades_per_second
FROM fx_trades {_frame(SLOW)}""")
def _(spark, d):
    out = flow.trade_intensity(_trades(spark, d), SLOW)
    return out.select(*ID, F.round("trades_per_second", 10).alias("trades_per_second"))


@query("large_trade_imbalance", T + f""", w AS (
  SELECT trade_id, exchange, symbol, ts_us,
         list(quantity) OVER w AS q, list(CASE side WHEN 'buy' THEN quantity ELSE -quantity END) OVER w AS s
  FROM fx_trades {_frame(SLOW)}),
t AS (SELECT *, list_sort(q)[least(CAST(floor(len(q) * 0.9) AS BIGINT), len(q) - 1) + 1] AS size_threshold FROM w)
SELECT trade_id, exchange, symbol, ts_us, size_threshold,
       round(list_sum(list_filter(s, lambda x: abs(x) >= size_threshold))
             / list_sum(list_filter(q, lambda x: x >= size_threshold)), 8) AS large_trade_imbalance
FROM t""")
def _(spark, d):
    out = flow.large_trade_imbalance(_trades(spark, d), SLOW, 0.9)
    return out.select(*ID, "size_threshold", F.round("large_trade_imbalance", 8).alias("large_trade_imbalance"))


@query("price_momentum", T + f""", v AS (
  SELECT trade_id, exchange, symbol, ts_us,
         sum(price * quantity) OVER f / sum(quantity) OVER f AS fast, sum(price * quantity) OVER w / sum(quantity) OVER w AS slow
  FROM fx_trades {_frame(SLOW)}, {_frame(FAST, 'f').replace('WINDOW ', '')})
SELECT trade_id, exchange, symbol, ts_us, round((fast - slow) / slow, 8) AS price_momentum FROM v""")
def _(spark, d):
    out = flow.price_momentum(_trades(spark, d), FAST, SLOW)
    return out.select(*ID, F.round("price_momentum", 8).alias("price_momentum"))


@query("event_history", T + f""", n AS (
  SELECT *, max(ts_us) OVER (PARTITION BY exchange, symbol) AS newest,
         row_number() OVER (PARTITION BY exchange, symbol ORDER BY ts_us DESC, trade_id DESC) AS back FROM fx_trades)
SELECT trade_id, exchange, symbol, ts_us, price, quantity, side FROM n
WHERE ts_us >= newest - {10 * 24 * HOUR} AND back <= 150""")
def _(spark, d):
    out = flow.event_history(_trades(spark, d), lookback_ms=10 * 24 * HOUR // 1000, last_n=150)
    return out.select(*ID, "price", "quantity", "side")


@query("dedupe_trades", T + """
SELECT DISTINCT exchange, symbol, price, quantity, side FROM fx_trades""")
def _(spark, d):
    return flow.dedupe_trades(
        _trades(spark, d).select("exchange", "symbol", "price", "quantity", "side"),
        ["exchange", "symbol", "price", "quantity", "side"],
    )


STALE_MS, MAX_CHANGE = 20 * 24 * 3_600_000, 5.0


@query("trade_validation", duck("fx_base", "fx_trades", extra={"a": """
  SELECT t.*, t.ts_us + CASE WHEN t.trade_id % 7 = 0 THEN 14400000000 ELSE 0 END AS arrival FROM fx_trades t"""}).replace("WITH", "WITH RECURSIVE", 1) + f""",
p AS (SELECT *, max(ts_us) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lts, (SELECT max(ts_us) FROM fx_trades) AS as_of
      FROM a WINDOW k AS (PARTITION BY exchange, symbol ORDER BY arrival, trade_id)),
e AS (SELECT *, CASE WHEN ts_us < lts THEN 'non_monotonic' WHEN (as_of - ts_us) / 1000 > {STALE_MS} THEN 'stale'
            WHEN price <= 0 THEN 'invalid_price' WHEN quantity <= 0 THEN 'invalid_quantity' END AS early FROM p)"""
       + last_accepted("e", "price", "arrival, trade_id", MAX_CHANGE) + """
SELECT trade_id, exchange, symbol, ts_us, coalesce(early, CASE WHEN outlier THEN 'outlier' END) AS violation
FROM numbered JOIN judged USING (exchange, symbol, nth)""")
def _(spark, d):
    trades = _trades(spark, d)
    arrival = F.col("ts_us") + F.when(F.col("trade_id") % 7 == 0, 4 * HOUR).otherwise(0)
    as_of = trades.agg(F.max("ts_us")).scalar()
    rows = trades.withColumn("arrival", arrival)
    return flow.trade_validation(rows, MAX_CHANGE, STALE_MS, as_of).select(*ID, "violation")


@query("late_rows", duck("fx_packets") + """, s AS (
  SELECT *, max(exchange_ms) OVER (PARTITION BY exchange, symbol ORDER BY recv_ms, event_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx
  FROM fx_packets WHERE stage = 'post_receive')
SELECT exchange, symbol, count(*) AS rows, count(*) FILTER (exchange_ms < mx - 3600000) AS late_rows,
       max(mx - exchange_ms) FILTER (exchange_ms < mx - 3600000) AS max_lateness_ms
FROM s GROUP BY ALL""")
def _(spark, d):
    packets = view(spark, d, "fx_packets").filter(F.col("stage") == "post_receive")
    return flow.late_rows(packets, 3_600_000, ["recv_ms", "event_id"])
