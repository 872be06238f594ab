"""Market-data views over the star-schema and event tables used for checks and benches.

Each view exists twice: as Spark SQL here (`view`) and as a DuckDB CTE (`duck`), so a
query and its oracle start from the same rows. `{day}`-style window sizes are parameters of
the queries because events are minutes apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.session import prepare

TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")

_VENUE = "CASE {0} % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'bybit' ELSE 'okx' END"
_SYMBOL = "concat('SYM', CAST({0} % 5 AS STRING))"

_SPARK = {
    "fx_base": f"""
        SELECT event_id, user_id, event_type, ts,
               CAST(round(value * 100) AS BIGINT) AS cents,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
               {_VENUE.format('event_id')} AS exchange, {_SYMBOL.format('user_id')} AS symbol,
               unix_micros(CAST(ts AS TIMESTAMP)) AS ts_us
        FROM {{events}}""",
    "fx_trades": """
        SELECT event_id AS trade_id, exchange, symbol, ts_us,
               100 + 10 * (user_id % 5) + CAST(cents % 1000 AS DOUBLE) / 100 AS price,
               CAST(k + 1 AS DOUBLE) AS quantity,
               CASE WHEN event_type IN ('click', 'purchase') THEN 'buy' ELSE 'sell' END AS side
        FROM {fx_base}""",
    "fx_quotes": """
        SELECT event_id AS seq, exchange, symbol, ts_us,
               100 + 10 * (user_id % 5) + CAST(cents % 4 - 1 - k % 5 AS DOUBLE) / 100 AS best_bid,
               CAST(k + 1 AS DOUBLE) AS bid_qty,
               100 + 10 * (user_id % 5) + CAST(cents % 4 + 1 + k % 5 AS DOUBLE) / 100 AS best_ask,
               CAST(101 - k AS DOUBLE) AS ask_qty
        FROM {fx_base}""",
    "fx_l2": f"""
        SELECT {_VENUE.format('venue')} AS exchange, {_SYMBOL.format('instrument')} AS symbol, seq, ts_us, seq AS update_id,
               seq % 50 = 0 AS is_snapshot, CASE WHEN is_bid THEN 'bid' ELSE 'ask' END AS side, price_ticks,
               CAST(price_ticks AS DOUBLE) / 100 AS price,
               max_by(quantity, struct(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS quantity
        FROM (SELECT l_suppkey % 3 AS venue, l_partkey % 5 AS instrument,
                     CAST(datediff(l_shipdate, DATE '1995-01-01') AS BIGINT) AS seq,
                     unix_micros(CAST(l_shipdate AS TIMESTAMP)) AS ts_us, l_linestatus = 'O' AS is_bid,
                     CASE l_linestatus WHEN 'O' THEN 9900 ELSE 10001 END + (l_partkey * 7 + l_linenumber) % 95
                       + CASE l_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE -20 END AS price_ticks,
                     CAST(CASE WHEN l_returnflag = 'N' AND l_discount >= 0.05 THEN 0.0 ELSE l_quantity END AS DOUBLE)
                       AS quantity,
                     l_orderkey, l_linenumber, l_partkey, l_suppkey
              FROM {{lineitem}})
        GROUP BY venue, instrument, seq, ts_us, is_bid, price_ticks""",
    "fx_packets": """
        SELECT stage, exchange, symbol, event_id,
               CASE WHEN event_id % 2 = 0 THEN 'TRADE' ELSE 'ORDERBOOK' END AS packet_type,
               ts_us div 1000 AS exchange_ms,
               ts_us div 1000 + k * 10 + CASE WHEN event_id % 7 = 0 THEN 14400000 ELSE 0 END
                 + CASE WHEN stage = 'post_receive' THEN ((event_id * 7919) % 4) * 3600000 ELSE 0 END AS recv_ms,
               60 + k * 20 AS size_bytes, event_id AS source_seq
        FROM {fx_base} LATERAL VIEW explode(array('pre_send', 'post_receive')) s AS stage""",
    "fx_fills": f"""
        SELECT {_VENUE.format('l_suppkey')} AS exchange, {_SYMBOL.format('l_partkey')} AS symbol,
               unix_micros(CAST(l_shipdate AS TIMESTAMP)) AS ts_us, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
               l_partkey, l_suppkey,
               CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linenumber % 2 = 0) THEN 'buy' ELSE 'sell' END
                 AS side,
               l_quantity AS quantity, l_extendedprice / l_quantity AS price
        FROM {{lineitem}}""",
    "fx_options": """
        SELECT p_partkey AS option_code, p_brand AS underlying,
               CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS option_type,
               100 + CAST(2.5 AS DOUBLE) * ((p_partkey div 2) % 40) AS strike_price,
               CAST(p_size % 3 AS BIGINT) AS expiry_idx,
               1 + CAST(p_partkey * 13 % 900 AS DOUBLE) / 100 AS current_price,
               10 + CAST(p_size AS DOUBLE) AS implied_volatility,
               CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END * CAST(p_partkey % 100 AS DOUBLE) / 100 AS delta,
               CAST(p_partkey % 50 AS DOUBLE) / 1000 AS gamma,
               p_partkey * 37 % 500 AS volume, p_partkey * 91 % 3000 AS open_interest
        FROM {part}""",
    "fx_realtime": """
        SELECT event_id AS id, symbol, CASE event_type WHEN 'view' THEN 'stock' WHEN 'click' THEN 'futures'
                 WHEN 'purchase' THEN 'options' WHEN 'signup' THEN 'etf' ELSE 'overseas_futures' END AS asset_type,
               100 + 10 * (user_id % 5) + CAST(cents % 1000 AS DOUBLE) / 100 AS current_price,
               CAST(cents % 1000 - 500 AS DOUBLE) / 100 AS change_rate, k AS volume, ts_us
        FROM {fx_base}""",
    "fx_ops": """
        SELECT ts_us, event_id, exchange, event_type,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' ELSE 'INFO' END AS level,
               CASE event_type WHEN 'signup' THEN 'connected' WHEN 'error' THEN 'disconnected'
                 WHEN 'view' THEN 'reconnecting' ELSE 'data' END AS conn_event,
               CAST(k AS DOUBLE) AS cpu_usage, CAST(cents AS DOUBLE) / 100 AS latency_ms, k * 10 AS messages_received,
               k * 10 - k % 3 AS messages_processed, k % 3 AS dropped_count
        FROM {fx_base}""",
}

_DUCK = {
    "fx_base": """
        SELECT event_id, user_id, event_type, ts, CAST(round(value * 100) AS BIGINT) AS cents,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
               CASE event_id % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'bybit' ELSE 'okx' END AS exchange,
               concat('SYM', CAST(user_id % 5 AS VARCHAR)) AS symbol, epoch_us(ts) AS ts_us
        FROM events""",
    "fx_trades": """
        SELECT event_id AS trade_id, exchange, symbol, ts_us,
               100 + 10 * (user_id % 5) + CAST(cents % 1000 AS DOUBLE) / 100 AS price,
               CAST(k + 1 AS DOUBLE) AS quantity,
               CASE WHEN event_type IN ('click', 'purchase') THEN 'buy' ELSE 'sell' END AS side
        FROM fx_base""",
    "fx_quotes": """
        SELECT event_id AS seq, exchange, symbol, ts_us,
               100 + 10 * (user_id % 5) + CAST(cents % 4 - 1 - k % 5 AS DOUBLE) / 100 AS best_bid,
               CAST(k + 1 AS DOUBLE) AS bid_qty,
               100 + 10 * (user_id % 5) + CAST(cents % 4 + 1 + k % 5 AS DOUBLE) / 100 AS best_ask,
               CAST(101 - k AS DOUBLE) AS ask_qty
        FROM fx_base""",
    "fx_l2": """
        SELECT exchange, symbol, seq, ts_us, seq AS update_id, seq % 50 = 0 AS is_snapshot, side, price_ticks,
               CAST(price_ticks AS DOUBLE) / 100 AS price, quantity
        FROM (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'bybit' ELSE 'okx' END AS exchange,
                     concat('SYM', CAST(l_partkey % 5 AS VARCHAR)) AS symbol,
                     CAST(datediff('day', TIMESTAMP '1995-01-01', l_shipdate) AS BIGINT) AS seq,
                     epoch_us(l_shipdate) AS ts_us,
                     CASE l_linestatus WHEN 'O' THEN 'bid' ELSE 'ask' END AS side,
                     CASE l_linestatus WHEN 'O' THEN 9900 ELSE 10001 END + (l_partkey * 7 + l_linenumber) % 95
                       + CASE l_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE -20 END AS price_ticks,
                     CAST(CASE WHEN l_returnflag = 'N' AND l_discount >= 0.05 THEN 0.0 ELSE l_quantity END AS DOUBLE)
                       AS quantity,
                     row_number() OVER (PARTITION BY l_suppkey % 3, l_partkey % 5, l_shipdate, l_linestatus,
                                        (l_partkey * 7 + l_linenumber) % 95
                                        ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn
              FROM lineitem)
        WHERE rn = 1""",
    "fx_packets": """
        SELECT stage, exchange, symbol, event_id,
               CASE WHEN event_id % 2 = 0 THEN 'TRADE' ELSE 'ORDERBOOK' END AS packet_type,
               ts_us // 1000 AS exchange_ms,
               ts_us // 1000 + k * 10 + CASE WHEN event_id % 7 = 0 THEN 14400000 ELSE 0 END
                 + CASE WHEN stage = 'post_receive' THEN ((event_id * 7919) % 4) * 3600000 ELSE 0 END AS recv_ms,
               60 + k * 20 AS size_bytes, event_id AS source_seq
        FROM fx_base CROSS JOIN (VALUES ('pre_send'), ('post_receive')) AS s(stage)""",
    "fx_fills": """
        SELECT CASE l_suppkey % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'bybit' ELSE 'okx' END AS exchange,
               concat('SYM', CAST(l_partkey % 5 AS VARCHAR)) AS symbol, epoch_us(l_shipdate) AS ts_us,
               l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
               CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linenumber % 2 = 0) THEN 'buy' ELSE 'sell' END
                 AS side,
               l_quantity AS quantity, l_extendedprice / l_quantity AS price
        FROM lineitem""",
    "fx_options": """
        SELECT p_partkey AS option_code, p_brand AS underlying,
               CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS option_type,
               100 + CAST(2.5 AS DOUBLE) * ((p_partkey // 2) % 40) AS strike_price,
               CAST(p_size % 3 AS BIGINT) AS expiry_idx,
               1 + CAST(p_partkey * 13 % 900 AS DOUBLE) / 100 AS current_price,
               10 + CAST(p_size AS DOUBLE) AS implied_volatility,
               CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END * CAST(p_partkey % 100 AS DOUBLE) / 100 AS delta,
               CAST(p_partkey % 50 AS DOUBLE) / 1000 AS gamma,
               p_partkey * 37 % 500 AS volume, p_partkey * 91 % 3000 AS open_interest
        FROM part""",
    "fx_realtime": """
        SELECT event_id AS id, symbol, CASE event_type WHEN 'view' THEN 'stock' WHEN 'click' THEN 'futures'
                 WHEN 'purchase' THEN 'options' WHEN 'signup' THEN 'etf' ELSE 'overseas_futures' END AS asset_type,
               100 + 10 * (user_id % 5) + CAST(cents % 1000 AS DOUBLE) / 100 AS current_price,
               CAST(cents % 1000 - 500 AS DOUBLE) / 100 AS change_rate, k AS volume, ts_us
        FROM fx_base""",
    "fx_ops": """
        SELECT ts_us, event_id, exchange, event_type,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' ELSE 'INFO' END AS level,
               CASE event_type WHEN 'signup' THEN 'connected' WHEN 'error' THEN 'disconnected'
                 WHEN 'view' THEN 'reconnecting' ELSE 'data' END AS conn_event,
               CAST(k AS DOUBLE) AS cpu_usage, CAST(cents AS DOUBLE) / 100 AS latency_ms, k * 10 AS messages_received,
               k * 10 - k % 3 AS messages_processed, k % 3 AS dropped_count
        FROM fx_base""",
}

_ON_EVENTS = ("fx_trades", "fx_quotes", "fx_packets", "fx_realtime", "fx_ops")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One fixture view as a DataFrame."""
    if name in TABLES:
        return table(spark, folder, name)
    source = {"fx_base": "events", "fx_options": "part", "fx_l2": "lineitem", "fx_fills": "lineitem"}.get(name, "fx_base")
    return spark.sql(_SPARK[name], **{source: view(spark, folder, source)})


def duck(*names: str, extra: dict[str, str] | None = None) -> str:
    """`WITH ...` text defining the named views (and what they need) for DuckDB."""
    needed: list[str] = []
    for name in names:
        if name in _ON_EVENTS and "fx_base" not in needed:
            needed.append("fx_base")
        if name not in needed:
            needed.append(name)
    parts = [f"{n} AS ({_DUCK[n]})" for n in needed]
    parts += [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"


def stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """The same view over a file stream of its table."""
    source = {"fx_base": "events", "fx_options": "part", "fx_l2": "lineitem", "fx_fills": "lineitem"}.get(name)
    if name in TABLES:
        schema = table(spark, folder, name).schema
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        return reader.option("pathGlobFilter", f"{name}*.parquet").parquet(folder)
    if source is None:
        return spark.sql(_SPARK[name], fx_base=stream(spark, folder, "fx_base", files_per_batch))
    return spark.sql(_SPARK[name], **{source: stream(spark, folder, source, files_per_batch)})
