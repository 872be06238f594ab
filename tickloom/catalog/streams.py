"""Streaming queries, run over everything the file source holds (available-now)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import query
from tickloom.catalog.book import MSG, builder_sql
from tickloom.catalog.ingest import SIDES
from tickloom.catalog.positions import FOLD, ORDER
from tickloom.catalog.quality import PK
from tickloom.catalog.venues import CONT, Q, STALE_MS
from tickloom.session import shared_dir
from tickloom.sources.fixtures import duck, stream, view
from tickloom.streaming import jobs

HOUR = 3_600_000_000


def run(spark, df, label):
    return jobs.run_available_now(spark, df, label)


def timed(df):
    return df.withColumn("ts", F.timestamp_micros("ts_us"))


def r(df, digits: int, *names: str):
    return df.withColumns({c: F.round(c, digits) for c in names})


def off_tie(df):
    """Mean prices of few trades can end in an exact 5; step off it before rounding."""
    return df.withColumn("vwap", F.round(F.col("vwap") + 1e-9, 6))


# Windows are final once the watermark (newest event time less the delay, in ms) has passed them.
@query("stream_features_tumbling", duck("fx_trades") + f""", w AS (SELECT *, ts_us // {HOUR} * {HOUR} AS start_us FROM fx_trades)
SELECT exchange, symbol, start_us, start_us + {HOUR} AS end_us, count(*) AS trades, round(sum(price * quantity) / sum(quantity) + 1e-9, 6) AS vwap,
  round(sum(CASE side WHEN 'buy' THEN price * quantity ELSE -price * quantity END) / sum(price * quantity), 8) AS trade_flow_imbalance,
  round(count(*) / 3600.0::DOUBLE, 8) AS trades_per_second FROM w
GROUP BY exchange, symbol, start_us HAVING start_us + {HOUR} <= (SELECT max(ts_us) // 1000 * 1000 FROM fx_trades) - 600000000""")
def _(spark, d):
    out = jobs.stream_features_tumbling(timed(stream(spark, d, "fx_trades")), "1 hour", None, "10 minutes")
    return r(off_tie(run(spark, out, "tumbling")), 8, "trade_flow_imbalance", "trades_per_second")


@query("stream_features_sliding", duck("fx_trades") + f""", w AS (SELECT t.*, (ts_us // {HOUR} - i) * {HOUR} AS start_us FROM fx_trades t CROSS JOIN range(0, 3) s(i))
SELECT exchange, symbol, start_us, start_us + {3 * HOUR} AS end_us, count(*) AS trades, round(sum(price * quantity) / sum(quantity) + 1e-9, 6) AS vwap FROM w
GROUP BY exchange, symbol, start_us HAVING start_us + {3 * HOUR} <= (SELECT max(ts_us) // 1000 * 1000 FROM fx_trades) - 600000000""")
def _(spark, d):
    out = jobs.stream_features_tumbling(timed(stream(spark, d, "fx_trades")), "3 hours", "1 hour", "10 minutes")
    return off_tie(run(spark, out, "sliding")).drop("trade_flow_imbalance", "trades_per_second")


GAP = 1_200_000_000


@query("stream_sessions", duck("fx_ops") + f""", g AS (SELECT *, coalesce(ts_us - lag(ts_us) OVER w >= {GAP}, true) AS starts FROM fx_ops WINDOW w AS (PARTITION BY exchange ORDER BY ts_us)),
n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY exchange ORDER BY ts_us) AS sid FROM g)
SELECT exchange, min(ts_us) AS start_us, max(ts_us) + {GAP} AS end_us, count(*) AS events, count(*) FILTER (level = 'ERROR') AS errors FROM n
GROUP BY exchange, sid HAVING max(ts_us) + {GAP} <= (SELECT max(ts_us) // 1000 * 1000 FROM fx_ops) - 600000000""")
def _(spark, d):
    return run(spark, jobs.stream_sessions(timed(stream(spark, d, "fx_ops")), "20 minutes", "10 minutes"), "sessions")


def raw_levels(df):
    """Level rows straight from the table; the order columns decide which entry of a price wins."""
    return df.selectExpr(
        "CASE l_suppkey % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'bybit' ELSE 'okx' END AS exchange",
        "concat('SYM', CAST(l_partkey % 5 AS STRING)) AS symbol", "CAST(datediff(l_shipdate, DATE '1995-01-01') AS BIGINT) AS seq",
        "unix_micros(CAST(l_shipdate AS TIMESTAMP)) AS ts_us", "CASE l_linestatus WHEN 'O' THEN 'bid' ELSE 'ask' END AS side",
        "CASE l_linestatus WHEN 'O' THEN 9900 ELSE 10001 END + (l_partkey * 7 + l_linenumber) % 95"
        " + CASE l_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE -20 END AS price_ticks",
        "CAST(CASE WHEN l_returnflag = 'N' AND l_discount >= 0.05 THEN 0.0 ELSE l_quantity END AS DOUBLE) AS quantity",
        "l_orderkey", "CAST(l_linenumber AS BIGINT) AS l_linenumber", "l_partkey", "l_suppkey",
    ).withColumn("is_snapshot", F.col("seq") % 50 == 0)


DAY = 86_400_000_000


@query("stream_book_builder", duck("fx_l2", extra={"msg": MSG}).replace("WITH", "WITH RECURSIVE", 1) + builder_sql("NULL::VARCHAR", 10 * DAY, DAY, 5 * DAY, 2) + """,
s AS (SELECT st.exchange, st.symbol, ms.seq, st.mode AS state, st.reason, st.attempt, max(CASE WHEN ms.is_snapshot THEN ms.seq END) OVER (
    PARTITION BY st.exchange, st.symbol ORDER BY ms.seq) AS epoch
  FROM st JOIN ms ON ms.exchange = st.exchange AND ms.symbol = st.symbol AND ms.nth = st.nth WHERE kind IN ('snap', 'hold', 'gap', 'apply')),
lv AS (SELECT s.exchange, s.symbol, s.seq, l.side, l.price_ticks, arg_max(l.quantity, l.seq) AS q, max(l.seq) AS latest FROM s JOIN fx_l2 l ON s.exchange = l.exchange
  AND s.symbol = l.symbol AND l.seq BETWEEN s.epoch AND s.seq WHERE s.state = 'live' GROUP BY ALL)
SELECT s.exchange, s.symbol, s.seq, s.state, any_value(s.reason) AS reason, CAST(any_value(s.attempt) AS BIGINT) AS attempt,
  max(price_ticks) FILTER (side = 'bid' AND q > 0) AS best_bid_ticks, min(price_ticks) FILTER (side = 'ask' AND q > 0) AS best_ask_ticks,
  count(*) FILTER (q > 0) AS levels, count(*) FILTER (latest = s.seq AND s.seq <> s.epoch) AS changed
FROM s LEFT JOIN lv ON s.exchange = lv.exchange AND s.symbol = lv.symbol AND s.seq = lv.seq GROUP BY ALL""")
def _(spark, d):
    rows = raw_levels(stream(spark, d, "lineitem"))
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = run(spark, jobs.stream_book_builder(rows, 864_000, order, 2, DAY // 1000, 5 * 86_400), "builder")
    # a snapshot also closes the levels before it; the rows it brings alone would need the book before
    return out.withColumn("changed", F.when(F.col("seq") % 50 == 0, 0).otherwise(F.size("changed")).cast("long")).drop("replayed")


@query("stream_inversions", PK + """
SELECT exchange, symbol, count(*) AS packets, count(*) FILTER (inverted) AS inversions, coalesce(max(inversion_ms), 0) AS max_inversion_ms,
  CAST(coalesce(sum(inversion_ms), 0) AS BIGINT) AS sum_inversion_ms FROM a GROUP BY ALL""")
def _(spark, d):
    rows = stream(spark, d, "fx_packets").filter("stage = 'post_receive'").select("exchange", "symbol", "event_id", "exchange_ms", "recv_ms")
    out = run(spark, jobs.stream_inversions(rows), "inversions")
    last = F.max_by(F.struct("inversions", "max_inversion_ms", "sum_inversion_ms"), "packets").alias("s")
    return out.groupBy("exchange", "symbol").agg(F.max("packets").alias("packets"), last).select("exchange", "symbol", "packets", "s.*")


@query("stream_nbbo", Q + "," + CONT + """
SELECT symbol, ts_us, seq, num_exchanges, num_checked, b.p AS best_bid, b.q AS bid_qty, b.x AS bid_exchange, a.p AS best_ask, a.q AS ask_qty, a.x AS ask_exchange FROM n""")
def _(spark, d):
    return run(spark, jobs.stream_nbbo(stream(spark, d, "fx_quotes"), STALE_MS), "nbbo")


@query("stream_positions", FOLD + """
SELECT exchange, symbol, quantity, round(avg_price, 4) AS avg_price, round(realised_pnl, 2) AS realised_pnl, fills FROM ps""")
def _(spark, d):
    out = run(spark, jobs.stream_positions(stream(spark, d, "fx_fills"), ORDER), "positions")
    last = F.max_by(F.struct("quantity", "avg_price", "realised_pnl", "fills"), "fills").alias("s")
    return r(r(out.groupBy("exchange", "symbol").agg(last).select("exchange", "symbol", "s.*"), 4, "avg_price"), 2, "realised_pnl")


@query("stream_merge_book_sides", SIDES)
def _(spark, d):
    rows = stream(spark, d, "fx_base").select(
        "exchange", "symbol", F.col("event_id").alias("seq"), F.when(F.col("k") % 2 == 0, "bid").otherwise("ask").alias("side"),
        (F.col("cents") % 3 != 0).alias("is_last"), F.array("cents").alias("levels"))
    return run(spark, jobs.stream_merge_book_sides(rows), "sides")


@query("stream_reorder", PK + f""", k AS (SELECT *, recv_ms // {12 * HOUR // 1000} AS flush FROM pk WHERE stage = 'post_receive')
SELECT exchange, symbol, event_id, flush, row_number() OVER (PARTITION BY exchange, symbol, flush ORDER BY recv_ms, event_id) AS arrival_pos,
  row_number() OVER (PARTITION BY exchange, symbol, flush ORDER BY exchange_ms, event_id) AS emit_pos FROM k
QUALIFY (flush + 1) * {12 * HOUR // 1000} <= (SELECT max(recv_ms) FROM k)""")
def _(spark, d):
    rows = stream(spark, d, "fx_packets").filter("stage = 'post_receive'").select("exchange", "symbol", "event_id", "exchange_ms", "recv_ms")
    return run(spark, jobs.stream_reorder(rows, 12 * HOUR // 1000), "reorder")


@query("stream_ops_sink", duck("fx_ops") + """
SELECT CASE level WHEN 'ERROR' THEN 'error' ELSE 'stats' END AS "table", count(*) AS rows, count(DISTINCT CAST(make_timestamp(ts_us) AS DATE)) AS days FROM fx_ops GROUP BY ALL""")
def _(spark, d):
    rows = timed(stream(spark, d, "fx_ops")).select(
        F.when(F.col("level") == "ERROR", "error").otherwise("stats").alias("table"), "ts",
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"), "exchange")
    root = shared_dir(spark, "opsink")
    jobs.stream_ops_sink(rows, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("table").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("days"))
