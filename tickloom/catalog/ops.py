"""Operational queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import query
from tickloom.catalog.book import ATTEMPTS, BACKOFF, BUFFER, BUILDER, CHUNK, L2, REST, TIMEOUT, UPD, flagged_messages, update_arrays
from tickloom.operators import book as b
from tickloom.operators import ops as o
from tickloom.operators.builder import builder_states
from tickloom.sources.fixtures import duck, view

DAY = 86_400_000_000
HOUR = 3_600_000_000
AS_OF = 1_704_067_200_000_000 + 15 * DAY
OPS = duck("fx_ops")
MEM = "(500 + messages_received % 97)"


def ops(spark, d):
    return view(spark, d, "fx_ops").withColumn("memory_mb", (500 + F.col("messages_received") % 97).cast("double"))


def r(df, digits: int, *names: str):
    return df.withColumns({c: F.round(c, digits) for c in names})


FLAGGED = L2 + UPD + """, fl AS (
  SELECT u.exchange, u.symbol, u.seq, u.ts_us, m.is_snapshot, coalesce(NOT m.is_snapshot AND u.seq <> lag(u.seq) OVER w + 1, false) AS has_gap,
    CASE WHEN coalesce(NOT m.is_snapshot AND u.seq <> lag(u.seq) OVER w + 1, false) THEN u.seq - lag(u.seq) OVER w - 1 ELSE 0 END AS missing,
    CASE WHEN u.ts_us < lts THEN 'non_monotonic' WHEN u.seq % 37 = 0 AND nb > 1 THEN 'bids_unsorted' WHEN bb >= ba THEN 'crossed' END AS violation, u.seq % 41 <> 0 AS checksum_ok, 60 + u.seq % 100 AS bytes
  FROM ul u JOIN msg m USING (exchange, symbol, seq) WINDOW w AS (PARTITION BY u.exchange, u.symbol ORDER BY u.seq))"""


def flagged(spark, d):
    updates = update_arrays(spark, d)
    checked = b.book_validation(updates, CHUNK, 0.3, 10**15, F.lit(0))
    gaps = b.seq_gaps(checked, CHUNK)
    return gaps.withColumns({"checksum_ok": F.col("seq") % 41 != 0, "bytes": 60 + F.col("seq") % 100})


@query("book_metrics", FLAGGED.replace("WITH", "WITH RECURSIVE", 1) + BUILDER + f""",
rs AS (SELECT exchange, symbol, s.seq, CAST(sum((trouble IS NOT NULL)::INT) AS BIGINT) AS resyncs,
         count(*) FILTER (kind = 'snap' AND before > 0) AS resyncs_ok, CAST(sum(failed - was_failed) AS BIGINT) AS resyncs_failed FROM (
  SELECT st.*, ms.seq, CASE WHEN st.resyncs > lag(st.resyncs, 1, 0) OVER w THEN 1 END AS trouble, lag(st.failed, 1, 0) OVER w AS was_failed,
         lag(st.attempt, 1, 0) OVER w AS before
  FROM st JOIN ms ON ms.exchange = st.exchange AND ms.symbol = st.symbol AND ms.nth = CASE WHEN kind IN ('buffering', 'resync', 'error') THEN st.nth + 1 ELSE st.nth END
  WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY st.exchange, st.symbol ORDER BY st.nth, kind NOT IN ('snap', 'hold', 'gap', 'apply'), st.since)) s GROUP BY ALL)
SELECT fl.exchange, fl.symbol, fl.ts_us // {100 * DAY} * {100 * DAY} AS window_us, count(*) AS updates, round(count(*) / {100 * DAY / 1e6}, 10) AS updates_per_second,
  count(*) FILTER (is_snapshot) AS snapshots, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (has_gap) AS gaps, CAST(sum(missing) AS BIGINT) AS missing,
  CAST(sum(rs.resyncs) AS BIGINT) AS resyncs, CAST(sum(rs.resyncs_ok) AS BIGINT) AS resyncs_ok, CAST(sum(rs.resyncs_failed) AS BIGINT) AS resyncs_failed, count(*) FILTER (violation = 'crossed') AS crossed, 0::BIGINT AS invalid,
  count(*) FILTER (violation = 'non_monotonic') AS stale, count(*) FILTER (NOT checksum_ok) AS checksum_failures, max(fl.ts_us) AS last_update_us
FROM fl JOIN rs ON rs.exchange = fl.exchange AND rs.symbol = fl.symbol AND rs.seq = fl.seq GROUP BY ALL""")
def _(spark, d):
    states = builder_states(flagged_messages(spark, d), CHUNK, BUFFER, TIMEOUT / 1e6, ATTEMPTS, BACKOFF // 1000, REST / 1e6)
    counted = flagged(spark, d).join(states.select("exchange", "symbol", "seq", "new_resyncs", "new_ok", "new_failed"), ["exchange", "symbol", "seq"])
    return r(o.book_metrics(counted, 100 * DAY), 10, "updates_per_second")


@query("health_check", FLAGGED + f""", h AS (
  SELECT exchange, symbol, max(ts_us) AS lu, count(*) FILTER (has_gap) AS gaps, count(*) FILTER (NOT checksum_ok OR violation = 'crossed') AS errors,
    (max(ts_us) - min(ts_us)) / 1000000 / 4000 AS up, 5000 + ascii(substr(symbol, 4, 1)) % 5 * 20000 AS p99 FROM fl GROUP BY ALL),
c AS (SELECT *, (1004832000000000 - lu) // 1000 AS age, gaps / up * 3600 AS g, errors / up * 3600 AS e FROM h)
SELECT exchange, symbol, age AS update_age_ms, round(g, 6) AS gap_rate, round(e, 6) AS error_rate,
  CASE WHEN age > 345600000 OR g > 100 OR e > 50 THEN 'Unhealthy' WHEN age > 172800000 OR g > 10 OR e > 5 OR p99 > 50000 THEN 'Degraded' ELSE 'Healthy' END AS status,
  concat_ws(', ', CASE WHEN NOT age < 172800000 THEN 'Update Recency' END, CASE WHEN NOT g < 10 THEN 'Gap Rate' END, CASE WHEN NOT e < 5 THEN 'Error Rate' END,
    CASE WHEN NOT p99 < 10000 THEN 'Latency' END) AS failed_checks, age < 172800000 AS synchronised FROM c""")
def _(spark, d):
    bad = ~F.col("checksum_ok") | F.coalesce(F.col("violation") == "crossed", F.lit(False))
    metrics = flagged(spark, d).groupBy("exchange", "symbol").agg(
        F.max("ts_us").alias("last_update_us"), F.count(F.when(F.col("has_gap"), 1)).alias("gaps"), F.count(F.when(bad, 1)).alias("errors"),
        ((F.max("ts_us") - F.min("ts_us")) / 1e6 / 4000).alias("uptime_seconds"),
    ).withColumn("p99_latency_us", 5000 + F.ascii(F.substring("symbol", 4, 1)) % 5 * 20000)
    out = o.health_check(metrics, 172_800_000, F.lit(1_004_832_000_000_000))
    return r(out, 6, "gap_rate", "error_rate").select(
        "exchange", "symbol", "update_age_ms", "gap_rate", "error_rate", "status", "failed_checks", "synchronised")


@query("ops_hourly", OPS + f"""
SELECT ts_us // {HOUR} * {HOUR} AS hour_us, exchange, CAST(grouping_id(ts_us // {HOUR} * {HOUR}, exchange) AS BIGINT) AS gid, CAST(sum(messages_processed) AS BIGINT) AS total_messages,
  count(*) FILTER (level = 'ERROR') AS total_errors, round(avg(cpu_usage), 6) AS avg_cpu_usage, round(avg({MEM}), 6) AS avg_memory_mb, max(latency_ms) AS max_latency_ms,
  count(*) FILTER (conn_event = 'disconnected') AS connection_drops, CAST(sum(dropped_count) AS BIGINT) AS dropped_messages,
  round(count(*) FILTER (conn_event <> 'disconnected') / count(*) * 100, 6) AS uptime_percent
FROM fx_ops GROUP BY GROUPING SETS ((ts_us // {HOUR} * {HOUR}, exchange), (ts_us // {HOUR} * {HOUR}))""")
def _(spark, d):
    rows = ops(spark, d)
    conn = rows.drop("event_type").withColumnRenamed("conn_event", "event_type")
    return r(o.ops_hourly(conn, rows, rows, rows), 6, "avg_cpu_usage", "avg_memory_mb", "uptime_percent")


@query("ops_monitoring_queries", OPS + f""", w AS (SELECT *, {MEM}::DOUBLE AS memory_mb, CASE event_id % 2 WHEN 0 THEN 'trade' ELSE 'orderbook' END AS data_type FROM fx_ops WHERE ts_us <= {AS_OF})
SELECT 'recent_connections' AS question, exchange, conn_event AS detail, count(*)::DOUBLE AS value FROM w WHERE ts_us > {AS_OF - HOUR} GROUP BY ALL
UNION ALL SELECT 'current_performance', exchange, 'cpu_usage', round(avg(cpu_usage), 6) FROM w WHERE ts_us > {AS_OF - 300_000_000} GROUP BY ALL
UNION ALL SELECT 'current_performance', exchange, 'memory_mb', round(avg(memory_mb), 6) FROM w WHERE ts_us > {AS_OF - 300_000_000} GROUP BY ALL
UNION ALL SELECT 'current_performance', exchange, 'latency_ms', round(avg(latency_ms), 6) FROM w WHERE ts_us > {AS_OF - 300_000_000} GROUP BY ALL
UNION ALL SELECT 'error_counts', exchange, 'errors', count(*) FROM w WHERE level = 'ERROR' AND ts_us > {AS_OF - HOUR} GROUP BY ALL
UNION ALL SELECT 'processing_rate', exchange, data_type, round(sum(messages_processed) / 60, 6) FROM w WHERE ts_us > {AS_OF - 60_000_000} GROUP BY ALL""")
def _(spark, d):
    rows = ops(spark, d).withColumn("data_type", F.when(F.col("event_id") % 2 == 0, "trade").otherwise("orderbook"))
    conn = rows.drop("event_type").withColumnRenamed("conn_event", "event_type")
    tables = {"connection": conn, "performance": rows, "error": rows.filter("level = 'ERROR'"), "stats": rows}
    return r(o.ops_monitoring_queries(tables, AS_OF), 6, "value")


@query("log_metrics", OPS + f"""
SELECT exchange, ts_us // {HOUR} * {HOUR} AS window_us, count(*) FILTER (level = 'ERROR') AS errors, count(*) FILTER (level = 'WARN') AS warnings,
  round(avg(latency_ms) FILTER (event_id % 3 <> 0), 6) AS avg_latency_ms, count(*) FILTER (conn_event = 'data' AND dropped_count > 0) AS drops,
  count(*) FILTER (conn_event = 'reconnecting') AS reconnects, count(*) AS entries FROM fx_ops GROUP BY ALL""")
def _(spark, d):
    text = F.when(F.col("conn_event") == "reconnecting", "Reconnecting to venue").when(
        (F.col("conn_event") == "data") & (F.col("dropped_count") > 0), "3 packets Dropped").otherwise("ok")
    logs = ops(spark, d).select(
        "exchange", F.timestamp_micros("ts_us").alias("ts"), "level", text.alias("message"),
        F.when(F.col("event_id") % 3 != 0, F.create_map(F.lit("latency_ms"), F.col("latency_ms").cast("string"))).alias("metadata"),
    )
    return r(o.log_metrics(logs, "1 hour"), 6, "avg_latency_ms")


@query("connection_summary", OPS + """
SELECT exchange, count(*) FILTER (conn_event = 'connected') AS connected, count(*) FILTER (conn_event = 'disconnected') AS disconnected,
  count(*) FILTER (conn_event = 'reconnecting') AS reconnects, count(*) FILTER (conn_event = 'disconnected') AS failures,
  arg_max('lost ' || event_id, ts_us) FILTER (conn_event = 'disconnected') AS last_error, max(ts_us) FILTER (conn_event = 'disconnected') AS last_error_us
FROM fx_ops GROUP BY ALL""")
def _(spark, d):
    lost = F.when(F.col("conn_event") == "disconnected", F.concat(F.lit("lost "), F.col("event_id").cast("string")))
    rows = ops(spark, d).withColumn("error_msg", lost).drop("event_type").withColumnRenamed("conn_event", "event_type")
    return o.connection_summary(rows)


@query("feed_liveness", duck("fx_trades", "fx_quotes") + f""", a AS (SELECT exchange, ts_us, 1 AS t, 0 AS b FROM fx_trades UNION ALL SELECT exchange, ts_us, 0, 1 FROM fx_quotes),
p AS (SELECT exchange, CAST(sum(t) AS BIGINT) AS trades, CAST(sum(b) AS BIGINT) AS books, min(ts_us) AS f, max(ts_us) AS last_us FROM a WHERE ts_us <= {AS_OF} GROUP BY ALL)
SELECT exchange, trades, books, last_us, ({AS_OF} - last_us) // 1000 AS age_ms, round((trades + books) / (({AS_OF} - f) / 1000000), 8) AS messages_per_second,
  CASE WHEN ({AS_OF} - last_us) // 1000 < 200000 THEN 'LIVE' WHEN ({AS_OF} - last_us) // 1000 < 500000 THEN 'DELAYED' ELSE 'STALE' END AS status FROM p""")
def _(spark, d):
    out = o.feed_liveness(view(spark, d, "fx_trades"), view(spark, d, "fx_quotes"), AS_OF, 200_000, 500_000)
    return r(out, 8, "messages_per_second")


@query("aging_report", OPS + f"""
SELECT exchange AS run_id, round(avg(cpu_usage), 6) AS avg_cpu, arg_min({MEM}::DOUBLE, ts_us) AS first_memory_mb, arg_max({MEM}::DOUBLE, ts_us) AS last_memory_mb,
  count(*) FILTER (event_type = 'reconnecting') AS reconnects, arg_max({MEM}::DOUBLE, ts_us) - arg_min({MEM}::DOUBLE, ts_us) AS memory_growth_mb,
  arg_max({MEM}, ts_us) - arg_min({MEM}, ts_us) <= 20 AS memory_ok, avg(cpu_usage) <= 49.5 AS cpu_ok, count(*) FILTER (event_type = 'reconnecting') <= 10 AS reconnects_ok
FROM (SELECT * REPLACE (conn_event AS event_type) FROM fx_ops) GROUP BY ALL""")
def _(spark, d):
    rows = ops(spark, d).drop("event_type").withColumnsRenamed({"conn_event": "event_type"}).withColumn("run_id", F.col("exchange"))
    return r(o.aging_report(rows, None, 20, 49.5, 10), 6, "avg_cpu")


@query("processing_fleet_totals", OPS + f""", l AS (SELECT exchange, arg_max(cpu_usage, ts_us) AS c, arg_max({MEM}::DOUBLE, ts_us) AS m, arg_max(messages_processed / 10, ts_us) AS dr,
   arg_max(messages_received // 100, ts_us) AS ws, arg_max(latency_ms, ts_us) AS lt FROM fx_ops GROUP BY ALL)
SELECT count(*) AS exchanges, round(avg(c), 6) AS mean_cpu, sum(m) AS memory_mb, round(sum(dr), 6) AS data_rate, CAST(sum(ws) AS BIGINT) AS connections,
  coalesce(string_agg(CASE WHEN c > 60 THEN exchange || ': high cpu' WHEN lt > 10 THEN exchange || ': high latency' END, '; ' ORDER BY exchange), '') AS issues FROM l""")
def _(spark, d):
    rows = ops(spark, d).withColumns({"data_rate": F.col("messages_processed") / 10, "websocket_count": F.expr("messages_received div 100")})
    return r(o.processing_fleet_totals(rows, 60, 10), 6, "mean_cpu", "data_rate")


@query("market_totals", duck("fx_trades", "fx_quotes") + """, a AS (SELECT exchange, 1 AS t, 0 AS b FROM fx_trades UNION ALL SELECT exchange, 0, 1 FROM fx_quotes)
SELECT exchange, CAST(sum(t) AS BIGINT) AS trades, CAST(sum(b) AS BIGINT) AS books, count(*) AS messages FROM a GROUP BY ROLLUP (exchange)""")
def _(spark, d):
    return o.market_totals(view(spark, d, "fx_trades"), view(spark, d, "fx_quotes"))
