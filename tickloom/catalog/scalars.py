"""Scaling, timestamp, symbol and routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import query
from tickloom.functions import scalars as s
from tickloom.operators import normalize as n
from tickloom.sources.fixtures import duck, view

BASE = duck("fx_base")


def base(spark, d):
    return view(spark, d, "fx_base")


@query("parse_scaled", BASE + """
SELECT event_id, CASE WHEN k % 10 = 0 THEN NULL
    ELSE CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END * (cents * 100000000 + (k % 90 + 10) * 1000000 + (k % 7) * 100000) END AS scaled
FROM fx_base""")
def _(spark, d):
    sign = F.when(F.col("k") % 2 == 0, "-").otherwise("")
    text = F.concat(sign, F.col("cents"), F.lit("."), F.col("k") % 90 + 10, F.col("k") % 7, F.lit("00000999"))
    text = F.when(F.col("k") % 10 == 0, F.concat(F.col("cents"), F.lit(".1.2"))).otherwise(text)
    return base(spark, d).select("event_id", s.parse_scaled(text, 8).alias("scaled"))


@query("rescale_e8", BASE + """
SELECT event_id, CASE WHEN k % 12 < 8 THEN cents * CAST(pow(10, 8 - k % 12) AS BIGINT)
    ELSE cents // CAST(pow(10, k % 12 - 8) AS BIGINT) END AS value_e8 FROM fx_base""")
def _(spark, d):
    return base(spark, d).select("event_id", s.rescale_e8(F.col("cents"), F.col("k") % 12).alias("value_e8"))


@query("scale_by_precision", BASE + """, t AS (
  SELECT event_id, exchange, CASE WHEN k % 3 = 0 THEN symbol || '/USDT' ELSE symbol || '/KRW' END AS symbol,
         cents / 100.0::DOUBLE AS price, k::DOUBLE AS quantity FROM fx_base),
z AS (SELECT *, CASE WHEN exchange = 'binance' AND symbol = 'SYM0/USDT' THEN 2 WHEN exchange = 'bybit' AND symbol LIKE '%/KRW' THEN 0
     WHEN symbol = 'SYM1/USDT' THEN 4 ELSE 8 END AS price_decimals,
   CASE WHEN exchange = 'binance' AND symbol = 'SYM0/USDT' THEN 6 WHEN exchange = 'bybit' AND symbol LIKE '%/KRW' THEN 8
     WHEN symbol = 'SYM1/USDT' THEN 3 ELSE 8 END AS quantity_decimals FROM t)
SELECT event_id, exchange, symbol, price_decimals, quantity_decimals,
       CAST(round(price * pow(10, price_decimals)) AS BIGINT) AS price_scaled,
       CAST(round(quantity * pow(10, quantity_decimals)) AS BIGINT) AS quantity_scaled FROM z""")
def _(spark, d):
    dim = spark.createDataFrame(
        [("binance", "SYM0/USDT", None, 2, 6), ("bybit", None, "KRW", 0, 8), (None, "SYM1/USDT", None, 4, 3)],
        "exchange string, symbol string, quote string, price_decimals int, quantity_decimals int",
    )
    rows = base(spark, d).select(
        "event_id", "exchange",
        F.concat("symbol", F.when(F.col("k") % 3 == 0, "/USDT").otherwise("/KRW")).alias("symbol"),
        (F.col("cents") / 100).alias("price"), F.col("k").cast("double").alias("quantity"),
    )
    return n.scale_by_precision(rows, dim).drop("price", "quantity")


@query("price_to_ticks", duck("fx_trades") + """, z AS (
  SELECT *, CASE exchange WHEN 'binance' THEN 0.05::DOUBLE ELSE 0.01::DOUBLE END AS tick_size FROM fx_trades WHERE exchange <> 'okx'),
y AS (SELECT *, CAST(floor(round(price / tick_size, 9)) AS BIGINT) AS price_ticks FROM z)
SELECT trade_id, exchange, symbol, price_ticks, round(price_ticks * tick_size, 6) AS tick_price,
       CAST(quantity * 100000000 AS BIGINT) AS quantity_e8 FROM y""")
def _(spark, d):
    dim = spark.createDataFrame(
        [(e, f"SYM{i}", t) for e, t in (("binance", 0.05), ("bybit", 0.01)) for i in range(5)],
        "exchange string, symbol string, tick_size double",
    )
    out = n.price_to_ticks(view(spark, d, "fx_trades"), dim)
    return out.select(
        "trade_id", "exchange", "symbol", "price_ticks", F.round("tick_price", 6).alias("tick_price"), "quantity_e8"
    )


UNIT = "CASE k % 4 WHEN 0 THEN 'seconds' WHEN 1 THEN 'milliseconds' WHEN 2 THEN 'microseconds' ELSE 'nanoseconds' END"


@query("ts_to_nanos", BASE + f""", z AS (
  SELECT event_id, {UNIT} AS timestamp_unit, CASE k % 4 WHEN 0 THEN CASE WHEN k % 8 = 0 THEN ts_us ELSE ts_us // 1000000 END
     WHEN 1 THEN ts_us // 1000 WHEN 2 THEN ts_us ELSE ts_us * 1000 END AS t, k FROM fx_base)
SELECT event_id, timestamp_unit, CASE WHEN k % 8 <> 0 THEN t * CASE k % 4 WHEN 0 THEN 1000000000 WHEN 1 THEN 1000000
     WHEN 2 THEN 1000 ELSE 1 END END AS ts_ns, k % 8 = 0 AS overflow FROM z""")
def _(spark, d):
    value = F.expr(
        "CASE k % 4 WHEN 0 THEN CASE WHEN k % 8 = 0 THEN ts_us ELSE ts_us div 1000000 END "
        "WHEN 1 THEN ts_us div 1000 WHEN 2 THEN ts_us ELSE ts_us * 1000 END"
    )
    rows = base(spark, d).select("event_id", F.expr(UNIT).alias("timestamp_unit"), value.alias("timestamp"))
    return n.ts_to_nanos(rows).drop("timestamp")


VENUE = "CASE event_id % 4 WHEN 0 THEN 'Binance' WHEN 1 THEN 'Upbit' WHEN 2 THEN 'Deribit' ELSE 'Other' END"


@query("normalize_ts", BASE + f"""
SELECT event_id, {VENUE} AS exchange, CASE WHEN event_id % 4 = 1 OR (event_id % 4 = 3 AND k % 4 = 0) THEN ts_us // 1000000 * 1000
     ELSE ts_us // 1000 END AS ts_ms FROM fx_base""")
def _(spark, d):
    value = F.expr(
        "CASE event_id % 4 WHEN 0 THEN ts_us div 1000 WHEN 1 THEN ts_us div 1000000 WHEN 2 THEN ts_us "
        "ELSE CASE k % 4 WHEN 0 THEN ts_us div 1000000 WHEN 1 THEN ts_us div 1000 WHEN 2 THEN ts_us ELSE ts_us * 1000 END END"
    )
    rows = base(spark, d).select("event_id", F.expr(VENUE).alias("exchange"), value.alias("timestamp"))
    return n.normalize_ts(rows).drop("timestamp")


MIXED = (
    "CASE k % 5 WHEN 0 THEN ts_us {div} 1000000 WHEN 1 THEN ts_us {div} 1000 WHEN 2 THEN ts_us WHEN 3 THEN event_id + 134456049 "
    "ELSE ts_us {div} 1000 - 100000000000 END"
)


@query("classify_ts", BASE + f""", z AS (SELECT event_id, k, ts_us, {MIXED.format(div='//')} AS t FROM fx_base)
SELECT event_id, k % 5 < 3 AS is_timestamp, CASE k % 5 WHEN 0 THEN t * 1000 WHEN 1 THEN t WHEN 2 THEN t // 1000 ELSE t END AS ts_ms
FROM z""")
def _(spark, d):
    rows = base(spark, d).select("event_id", "ts_us", F.expr(MIXED.format(div="div")).alias("timestamp"))
    return n.classify_ts(rows, F.floor(F.col("ts_us") / 1000)).select("event_id", "is_timestamp", "ts_ms")


@query("repair_ts", BASE + f""", z AS (SELECT event_id, k, ts_us, {MIXED.format(div='//')} AS t FROM fx_base)
SELECT event_id, CASE k % 5 WHEN 0 THEN t * 1000 WHEN 1 THEN t WHEN 2 THEN t // 1000 ELSE ts_us // 1000 END AS ts_ms FROM z""")
def _(spark, d):
    rows = base(spark, d).select(
        "event_id", F.expr(MIXED.format(div="div")).alias("timestamp"), F.expr("ts_us div 1000").alias("recv_ms")
    )
    return n.repair_ts(rows).select("event_id", "ts_ms")


NATIVE = (
    "CASE event_id % 4 WHEN 0 THEN concat(symbol, CASE k % 4 WHEN 0 THEN 'USDT' WHEN 1 THEN 'BUSD' WHEN 2 THEN 'BTC' ELSE 'XYZ' END) "
    "WHEN 1 THEN concat(symbol, CASE k % 3 WHEN 0 THEN 'USDC' WHEN 1 THEN 'USDT' ELSE 'BUSD' END) "
    "WHEN 2 THEN concat(CASE k % 3 WHEN 0 THEN 'KRW-' WHEN 1 THEN 'BTC-' ELSE 'EUR-' END, symbol) ELSE concat(symbol, 'USDT') END"
)
VENUE3 = "CASE event_id % 4 WHEN 0 THEN 'Binance' WHEN 1 THEN 'Bybit' WHEN 2 THEN 'Upbit' ELSE 'OKX' END"


@query("common_symbol", BASE + f"""
SELECT event_id, {VENUE3} AS exchange, {NATIVE} AS native_symbol, CASE event_id % 4
   WHEN 0 THEN symbol || CASE k % 4 WHEN 0 THEN '-USDT' WHEN 1 THEN '-BUSD' WHEN 2 THEN '-BTC' ELSE 'XYZ' END
   WHEN 1 THEN symbol || CASE k % 3 WHEN 0 THEN '-USDC' WHEN 1 THEN '-USDT' ELSE 'BUSD' END
   WHEN 2 THEN CASE k % 3 WHEN 0 THEN symbol || '-KRW' WHEN 1 THEN symbol || '-BTC' ELSE 'EUR-' || symbol END
   ELSE symbol || 'USDT' END AS common_symbol FROM fx_base""")
def _(spark, d):
    rows = base(spark, d).select("event_id", F.expr(VENUE3).alias("exchange"), F.expr(NATIVE).alias("native_symbol"))
    return n.common_symbol(rows)


def dim_symbol(spark):
    """Mapping of the fixture symbols; SYM4 is left out on every venue."""
    return spark.createDataFrame(
        [(e, f"SYM{i}", f"SYM{i}-USDT") for e in ("binance", "bybit", "okx") for i in range(4)],
        "exchange string, native_symbol string, common_symbol string",
    )


def native(spark, d):
    return base(spark, d).select("event_id", "exchange", F.col("symbol").alias("native_symbol"))


@query("map_symbol", BASE + """
SELECT event_id, exchange, symbol AS native_symbol, symbol || '-USDT' AS symbol FROM fx_base WHERE symbol <> 'SYM4'""")
def _(spark, d):
    return n.map_symbol(native(spark, d), dim_symbol(spark), "drop")


@query("map_symbol_keep", BASE + """
SELECT event_id, exchange, symbol AS native_symbol, CASE WHEN symbol <> 'SYM4' THEN symbol || '-USDT' ELSE symbol END AS symbol FROM fx_base""")
def _(spark, d):
    return n.map_symbol(native(spark, d), dim_symbol(spark), "keep")


@query("unmapped_symbols", BASE + """
SELECT exchange, symbol AS native_symbol, count(*) AS messages FROM fx_base WHERE symbol = 'SYM4' GROUP BY ALL""")
def _(spark, d):
    return n.unmapped_symbols(native(spark, d), dim_symbol(spark))


@query("symbol_ids", BASE + """
SELECT event_id, exchange, symbol, dense_rank() OVER (ORDER BY exchange) - 1 AS exchange_id,
       dense_rank() OVER (ORDER BY symbol) - 1 AS symbol_id FROM fx_base""")
def _(spark, d):
    return n.symbol_ids(base(spark, d).select("event_id", "exchange", "symbol"))


@query("distinct_symbols", duck("fx_trades") + """
SELECT DISTINCT exchange, symbol FROM fx_trades UNION SELECT DISTINCT 'listing', p_brand FROM part""")
def _(spark, d):
    listed = view(spark, d, "part").select(F.lit("listing").alias("exchange"), F.col("p_brand").alias("symbol"))
    return n.distinct_symbols(view(spark, d, "fx_trades").select("exchange", "symbol"), listed)


ROUTE = {
    "crypto": {"symbols": ["SYM0", "SYM1", "SYM2"], "exchanges": ["binance", "okx"]},
    "stock": {"enable_derivatives": False, "enable_etf": True, "asset_types": ["stock", "etf"]},
}
ROUTED = duck("fx_base", "fx_realtime") + """, rt AS (
  SELECT r.id, b.exchange, r.symbol, r.asset_type, CASE WHEN r.id % 3 = 0 THEN 'orderbook' ELSE 'trade' END AS data_type,
         CASE WHEN b.k % 2 = 0 THEN 'crypto' ELSE 'stock' END AS flow FROM fx_realtime r JOIN fx_base b ON r.id = b.event_id),
ro AS (SELECT * FROM rt WHERE CASE flow WHEN 'crypto' THEN symbol IN ('SYM0', 'SYM1', 'SYM2') AND exchange IN ('binance', 'okx')
   ELSE asset_type IN ('stock', 'etf') END)
"""


def routed(spark, d):
    rows = view(spark, d, "fx_realtime").withColumns({
        "exchange": F.expr("CASE id % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'bybit' ELSE 'okx' END"),
        "data_type": F.when(F.col("id") % 3 == 0, "orderbook").otherwise("trade"),
        "flow_in": F.when(F.col("volume") % 2 == 0, "crypto").otherwise("stock"),
    })
    return n.route_market_data(rows.select("id", "exchange", "symbol", "asset_type", "data_type", "flow_in"), ROUTE)


@query("route_market_data", ROUTED + "SELECT id, exchange, symbol, asset_type, data_type, flow FROM ro")
def _(spark, d):
    return routed(spark, d)


@query("routing_counts", ROUTED + """
SELECT flow, data_type, CAST(grouping_id(flow, data_type) AS BIGINT) AS gid, count(*) AS rows FROM ro GROUP BY CUBE (flow, data_type)""")
def _(spark, d):
    return n.routing_counts(routed(spark, d))


@query("safe_log_fields", """
SELECT doc_id, replace(replace(replace(replace(CASE WHEN length(text) <= 800 THEN text
     ELSE substr(text, 1, 800) || '... (' || length(text) || ' chars)' END, '\\', '\\\\'), '"', '\\"'), chr(13), '\\r'), chr(10), '\\n') AS message
FROM documents""")
def _(spark, d):
    from tickloom.sources.fixtures import table

    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("message"))
    return n.safe_log_fields(rows, 800)
