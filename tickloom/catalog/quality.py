"""Stream-quality queries over sent and received packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import query
from tickloom.operators import quality as q
from tickloom.plans.ordered import chunk_of, cumsum, scan
from tickloom.sources.fixtures import duck, view

KEY = ["exchange", "symbol"]


def packets(spark, d, stage: str | None = "post_receive"):
    rows = view(spark, d, "fx_packets")
    rows = scan(rows, ["stage", *KEY], ["event_id"], chunk_of("event_id", 1000), sequence=cumsum(F.lit(1)))
    return rows.filter(F.col("stage") == stage) if stage else rows


PK = duck("fx_packets", extra={
    "pk": "SELECT *, row_number() OVER (PARTITION BY stage, exchange, symbol ORDER BY event_id) AS sequence FROM fx_packets",
    "al": """SELECT *, coalesce(exchange_ms < prev_ms, false) AS inverted, recv_ms - exchange_ms AS latency_ms,
        CASE WHEN exchange_ms < prev_ms THEN prev_ms - exchange_ms END AS inversion_ms,
        CASE WHEN sequence > pseq + 1 THEN sequence - pseq - 1 END AS gap_size,
        coalesce(sequence <= pseq, false) AS out_of_order
      FROM (SELECT *, lag(exchange_ms) OVER w AS prev_ms, lag(sequence) OVER w AS pseq FROM pk
            WINDOW w AS (PARTITION BY stage, exchange, symbol ORDER BY recv_ms, event_id))""",
    "a": "SELECT * FROM al WHERE stage = 'post_receive'",
})
LEVEL = "CASE grouping_id(exchange, symbol) WHEN 0 THEN 'symbol' WHEN 1 THEN 'exchange' ELSE 'all' END AS level"


def r(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("latency_stats", PK + f"""
SELECT exchange, symbol, {LEVEL}, count(*) AS packets, round(avg(latency_ms), 4) AS mean_ms,
       round(stddev_samp(latency_ms), 4) AS std_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms
FROM a GROUP BY ROLLUP (exchange, symbol)""")
def _(spark, d):
    return r(q.latency_stats(packets(spark, d)), mean_ms=4, std_ms=4)


@query("latency_percentiles", PK + """, n AS (
  SELECT exchange, latency_ms, row_number() OVER (PARTITION BY exchange ORDER BY latency_ms) - 1 AS i,
         count(*) OVER (PARTITION BY exchange) AS n FROM a)
SELECT exchange, n, max(latency_ms) FILTER (i = (n - 1) * 50 // 100) AS p50_ms,
       max(latency_ms) FILTER (i = (n - 1) * 95 // 100) AS p95_ms, max(latency_ms) FILTER (i = (n - 1) * 99 // 100) AS p99_ms
FROM n GROUP BY ALL""")
def _(spark, d):
    return q.latency_percentiles(packets(spark, d), exact=True, value_chunk_ms=1_000_000)


@query("latency_percentiles_of_n", PK + """, n AS (
  SELECT exchange, latency_ms, row_number() OVER (PARTITION BY exchange ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY exchange) AS n FROM a)
SELECT exchange, n, max(latency_ms) FILTER (i = n * 50 // 100) AS p50_ms, max(latency_ms) FILTER (i = n * 95 // 100) AS p95_ms,
       max(latency_ms) FILTER (i = n * 99 // 100) AS p99_ms FROM n GROUP BY ALL""")
def _(spark, d):
    return q.latency_percentiles(packets(spark, d), exact=True, value_chunk_ms=1_000_000, of="n")


INV = """count(*) AS packets, count(*) FILTER (inverted) AS inversions,
       round(count(*) FILTER (inverted) / count(*) * 100, 6) AS inversion_pct, max(inversion_ms) AS max_inversion_ms,
       round(avg(inversion_ms), 4) AS mean_inversion_ms, min(inversion_ms) AS min_inversion_ms"""


@query("inversion_stats", PK + f"SELECT exchange, symbol, {LEVEL}, {INV} FROM a GROUP BY ROLLUP (exchange, symbol)")
def _(spark, d):
    return r(q.inversion_stats(packets(spark, d)), inversion_pct=6, mean_inversion_ms=4)


@query("sequence_gap_stats", PK + """
SELECT exchange, symbol, count(*) AS packets, count(gap_size) AS gaps, CAST(sum(gap_size) AS BIGINT) AS missing,
       max(gap_size) AS max_gap, count(*) FILTER (out_of_order) AS out_of_order FROM a GROUP BY ALL""")
def _(spark, d):
    return q.sequence_gap_stats(packets(spark, d))


@query("stream_health_score", PK + """, h AS (
  SELECT exchange, count(*) FILTER (inverted) / count(*) * 100 AS i, count(gap_size) / count(*) * 100 AS g FROM a GROUP BY ALL)
SELECT exchange, round(i, 6) AS inversion_pct, round(g, 6) AS gap_pct,
       round(greatest(0, least(100, 100 - 10 * i - 5 * g)), 6) AS score,
       CASE WHEN i < 0.1 THEN 'EXCELLENT' WHEN i < 1 THEN 'GOOD' ELSE 'POOR' END AS grade FROM h""")
def _(spark, d):
    return r(q.stream_health_score(packets(spark, d)), inversion_pct=6, gap_pct=6, score=6)


@query("inversion_buckets", PK + """, b AS (
  SELECT *, CASE WHEN inversion_ms < 10 THEN 'tiny' WHEN inversion_ms < 100 THEN 'small' WHEN inversion_ms < 1000 THEN 'medium'
                 WHEN inversion_ms > 1000000000 THEN 'format_jump' ELSE 'large' END AS bucket FROM a WHERE inverted)
SELECT exchange, bucket, CAST(grouping_id(exchange, bucket) AS BIGINT) AS gid, count(*) AS inversions,
       max(inversion_ms) AS max_inversion_ms FROM b GROUP BY CUBE (exchange, bucket)""")
def _(spark, d):
    return q.inversion_buckets(packets(spark, d))


@query("inversion_hours", PK + """
SELECT exchange, (recv_ms // 3600000) % 24 AS hour, count(*) AS inversions FROM a WHERE inverted GROUP BY ALL""")
def _(spark, d):
    return q.inversion_hours(packets(spark, d))


@query("inversion_latency_correlation", PK + """
SELECT exchange, symbol, count(*) AS packets, count(*) FILTER (inverted) AS inversions,
  count(*) FILTER (inverted AND latency_ms < 10) AS delay_0,
  count(*) FILTER (inverted AND latency_ms >= 10 AND latency_ms < 50) AS delay_1,
  count(*) FILTER (inverted AND latency_ms >= 50 AND latency_ms < 100) AS delay_2,
  count(*) FILTER (inverted AND latency_ms >= 100 AND latency_ms < 500) AS delay_3,
  count(*) FILTER (inverted AND latency_ms >= 500 AND latency_ms < 1000) AS delay_4,
  count(*) FILTER (inverted AND latency_ms >= 1000) AS delay_5,
  count(*) FILTER (inverted AND latency_ms > 1000) AS high_latency_inversions,
  count(*) FILTER (inverted AND latency_ms <= 1000) AS low_latency_inversions,
  round(count(*) FILTER (inverted) / count(*) * 100, 6) AS inversion_pct FROM a GROUP BY exchange, symbol""")
def _(spark, d):
    return r(q.inversion_latency_correlation(packets(spark, d)), inversion_pct=6)


@query("inter_arrival_gaps", PK + """, g AS (
  SELECT *, exchange_ms - lag(exchange_ms) OVER (PARTITION BY exchange, symbol ORDER BY recv_ms, event_id) AS gp
  FROM pk WHERE stage = 'post_receive')
SELECT exchange, min(gp) FILTER (gp >= 0) AS min_gap_ms, round(avg(gp) FILTER (gp >= 0), 4) AS avg_gap_ms,
       max(gp) FILTER (gp >= 0) AS max_gap_ms, count(DISTINCT symbol) AS active_symbols FROM g GROUP BY ALL""")
def _(spark, d):
    return r(q.inter_arrival_gaps(packets(spark, d)), avg_gap_ms=4)


@query("inversion_diagnosis", PK + """, p AS (
  SELECT exchange, count(*) AS n, count(*) FILTER (inverted) AS inv, count(*) FILTER (inverted AND latency_ms >= 1000) AS slow,
         count(*) FILTER (inverted AND inversion_ms < 10) AS tiny FROM a GROUP BY ALL),
t AS (SELECT CAST(sum(n) AS BIGINT) AS packets, CAST(sum(inv) AS BIGINT) AS inversions, CAST(sum(slow) AS BIGINT) AS slow_inversions,
             CAST(sum(tiny) AS BIGINT) AS tiny_inversions, max(inv) AS worst_inversions FROM p)
SELECT *, CASE WHEN inversions = 0 THEN 'clean' WHEN worst_inversions > inversions * 0.8 THEN 'single_venue'
  WHEN tiny_inversions > inversions * 0.7 THEN 'batching' WHEN slow_inversions > inversions * 0.7 THEN 'network'
  WHEN slow_inversions < inversions * 0.3 THEN 'source' ELSE 'mixed' END AS verdict FROM t""")
def _(spark, d):
    return q.inversion_diagnosis(packets(spark, d))


@query("inversion_causes", PK + """, nx AS (
  SELECT *, lead(inverted) OVER w AS ninv, lead(recv_ms) OVER w AS nms, lead(event_id) OVER w AS nid FROM a WINDOW w AS (PARTITION BY exchange, symbol ORDER BY recv_ms, event_id)),
hit AS (SELECT *, coalesce(lag(exchange) OVER g = exchange AND lag(symbol) OVER g = symbol, false) AS consecutive FROM nx WHERE inverted WINDOW g AS (ORDER BY recv_ms, event_id)),
brk AS (SELECT *, coalesce(lag(consecutive) OVER g AND NOT coalesce(NOT lag(ninv) OVER g AND (lag(nms) OVER g < recv_ms OR (lag(nms) OVER g = recv_ms AND lag(nid) OVER g < event_id)),
    false), false) AS running FROM hit WINDOW g AS (ORDER BY recv_ms, event_id)),
c AS (SELECT count(*) AS inversions, count(*) FILTER (inversion_ms < 10) AS tiny_inversions, count(*) FILTER (inversion_ms >= 1000) AS large_inversions,
  count(*) FILTER (consecutive) AS consecutive, count(*) FILTER (NOT consecutive AND NOT running) AS isolated, count(DISTINCT exchange) AS venues FROM brk)
SELECT *, CASE WHEN inversions = 0 THEN 'clean' WHEN tiny_inversions > inversions * 7 // 10 THEN 'network' WHEN large_inversions > inversions // 3 THEN 'timestamps'
  WHEN consecutive > isolated THEN 'buffering' WHEN venues = 1 THEN 'single_venue' ELSE 'mixed' END AS verdict FROM c""")
def _(spark, d):
    return q.inversion_causes(packets(spark, d))


@query("packet_integrity", PK + """
SELECT exchange, count(*) AS packets, count(*) FILTER (size_bytes > 1400) AS oversized, count(*) FILTER (size_bytes > 1500) AS fragmented,
       count(*) FILTER (event_id % 50 = 0) AS clock_implausible, count(*) FILTER (event_id % 23 = 0) AS parse_errors,
       count(*) FILTER (event_id % 23 = 0) AS corrupt FROM a GROUP BY ALL""")
def _(spark, d):
    rows = view(spark, d, "fx_packets").filter("stage = 'post_receive'").withColumns({
        "parse_ok": F.col("event_id") % 23 != 0,
        "recv_ms": F.when(F.col("event_id") % 50 == 0, F.col("recv_ms") + 400 * q.DAY_MS).otherwise(F.col("recv_ms")),
    })
    return q.packet_integrity(rows)


@query("timestamp_format_report", PK + """, f AS (
  SELECT *, CASE WHEN event_id % 10 = 0 THEN exchange_ms // 1000 WHEN event_id % 10 = 1 THEN exchange_ms * 1000 ELSE exchange_ms END AS raw_ts
  FROM pk WHERE stage = 'post_receive'),
g AS (SELECT *, length(CAST(raw_ts AS VARCHAR)) AS digits, lag(length(CAST(raw_ts AS VARCHAR))) OVER w AS pd,
             row_number() OVER (PARTITION BY exchange ORDER BY recv_ms DESC, event_id DESC) AS rn
      FROM f WINDOW w AS (PARTITION BY exchange ORDER BY recv_ms, event_id)),
m AS (SELECT exchange, CAST(mode(digits) AS INT) AS digits, count(*) AS packets, count(*) FILTER (pd <> digits) AS format_switches,
             string_agg(CAST(raw_ts AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 3) AS last_samples FROM g GROUP BY ALL)
SELECT *, CASE WHEN digits <= 10 THEN 'seconds' WHEN digits <= 13 THEN 'milliseconds' ELSE 'microseconds' END AS format FROM m""")
def _(spark, d):
    at, ms = F.col("event_id") % 10, F.col("exchange_ms")
    raw = F.when(at == 0, F.floor(ms / 1000)).when(at == 1, ms * 1000).otherwise(ms)
    rows = view(spark, d, "fx_packets").filter("stage = 'post_receive'").withColumn("raw_ts", raw)
    return q.timestamp_format_report(rows)


HOUR = 3_600_000


@query("burst_inversions", PK + f""", w AS (
  SELECT exchange, symbol, event_id, recv_ms, inversion_ms, count(*) OVER (PARTITION BY exchange, symbol ORDER BY recv_ms
     RANGE BETWEEN {12 * HOUR - 1} PRECEDING AND CURRENT ROW) AS recent FROM a WHERE inverted)
SELECT *, CASE WHEN recent > 3 THEN 'burst' ELSE 'isolated' END AS kind FROM w""")
def _(spark, d):
    out = q.burst_inversions(packets(spark, d), 12 * HOUR, 3)
    return out.select("exchange", "symbol", "event_id", "recv_ms", "inversion_ms", "recent", "kind")


@query("consecutive_inversions", PK + """, m AS (
  SELECT *, sum((NOT inverted)::INT) OVER (PARTITION BY exchange, symbol ORDER BY recv_ms, event_id) AS run FROM a),
l AS (SELECT exchange, symbol, run, count(*) AS len FROM m WHERE inverted GROUP BY ALL)
SELECT exchange, symbol, count(*) AS runs, max(len) AS longest_run, count(*) FILTER (len = 1) AS isolated,
       CAST(sum(len) AS BIGINT) AS inversions FROM l GROUP BY ALL""")
def _(spark, d):
    return q.consecutive_inversions(packets(spark, d))


@query("per_minute_series", PK + f"""
SELECT exchange, recv_ms // {HOUR} * {HOUR} AS window_ms, count(*) AS packets, count(*) FILTER (inverted) AS inversions
FROM a GROUP BY ALL""")
def _(spark, d):
    return q.per_minute_series(packets(spark, d), HOUR)


PER = PK + """, p AS (SELECT exchange, symbol, count(*) AS packets, count(*) FILTER (inverted) AS inversions FROM a GROUP BY ALL)
"""


@query("topk_problem_symbols", PER + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exchange ORDER BY inversions DESC, symbol) AS rank FROM p) WHERE rank <= 3""")
def _(spark, d):
    return q.topk_problem_symbols(packets(spark, d), 3)


@query("worst_exchange", PER + """
SELECT exchange, CAST(sum(inversions) AS BIGINT) AS inversions FROM p GROUP BY ALL ORDER BY 2 DESC, 1 DESC LIMIT 1""")
def _(spark, d):
    return q.worst_exchange(packets(spark, d))


@query("active_symbols_topk", PER + """
SELECT exchange, symbol, packets, inversions, round(inversions / packets * 100, 6) AS inversion_pct,
       greatest((SELECT count(*) FROM p) - 10, 0) AS remaining FROM p ORDER BY packets DESC, exchange, symbol LIMIT 10""")
def _(spark, d):
    return r(q.active_symbols_topk(packets(spark, d), 10), inversion_pct=6)


@query("pre_post_compare", PK + """
SELECT exchange, symbol, count(*) FILTER (stage = 'pre_send') AS pre_packets,
       count(*) FILTER (stage = 'pre_send' AND inverted) AS pre_inversions, count(*) FILTER (stage = 'post_receive') AS post_packets,
       count(*) FILTER (stage = 'post_receive' AND inverted) AS post_inversions,
       count(*) FILTER (stage = 'post_receive' AND inverted) - count(*) FILTER (stage = 'pre_send' AND inverted) AS added_inversions,
       count(*) FILTER (stage = 'pre_send') - count(*) FILTER (stage = 'post_receive') AS lost_packets FROM al GROUP BY ALL""")
def _(spark, d):
    return q.pre_post_compare(packets(spark, d, None))


@query("propagated_inversions", PK + """
SELECT r.exchange, r.symbol, r.event_id, r.inversion_ms, CASE WHEN EXISTS (
    SELECT 1 FROM al s WHERE s.stage = 'pre_send' AND s.inverted AND s.exchange = r.exchange AND s.symbol = r.symbol
      AND s.prev_ms = r.prev_ms AND s.exchange_ms = r.exchange_ms) THEN 'propagated' ELSE 'network' END AS origin
FROM a r WHERE r.inverted""")
def _(spark, d):
    out = q.propagated_inversions(packets(spark, d, "pre_send"), packets(spark, d))
    return out.select("exchange", "symbol", "event_id", "inversion_ms", "origin")


@query("partition_balance", PK + """, s AS (
  SELECT ('0x' || substr(md5(exchange || ':' || symbol), 1, 8))::BIGINT % 4 AS shard, count(*) AS packets,
         CAST(sum(size_bytes) AS BIGINT) AS bytes, count(DISTINCT exchange || symbol) AS keys FROM a GROUP BY 1),
m AS (SELECT *, sum(packets) OVER () / 4 AS mean_packets FROM s),
v AS (SELECT *, abs(packets - mean_packets) / mean_packets * 100 AS dv FROM m)
SELECT shard, packets, bytes, keys, mean_packets, round(dv, 6) AS deviation_pct, max(dv) OVER () <= 50 AS balanced FROM v""")
def _(spark, d):
    return r(q.partition_balance(view(spark, d, "fx_packets").filter("stage = 'post_receive'")), deviation_pct=6)


@query("packet_mix", PK + """
SELECT exchange AS venue, CASE event_id % 4 WHEN 0 THEN 'futures' ELSE 'spot' END AS asset, count(*) AS packets,
       count(*) FILTER (event_id % 2 = 0 AND event_id % 11 <> 0) AS trades,
       count(*) FILTER (event_id % 2 = 1 AND event_id % 11 <> 0) AS orderbooks,
       count(*) FILTER (event_id % 11 = 0) AS text, max(recv_ms) AS last_seen_ms FROM a GROUP BY ALL""")
def _(spark, d):
    at = F.col("event_id")
    source = F.when(at % 4 == 0, F.concat("exchange", F.lit("_futures"))).otherwise(F.col("exchange"))
    rows = view(spark, d, "fx_packets").filter("stage = 'post_receive'").withColumns({
        "source": source, "packet_type": F.when(at % 11 == 0, "STATS").otherwise(F.col("packet_type")),
    })
    return q.packet_mix(rows)


@query("reorder_by_event_time", PK + f"""
SELECT exchange, symbol, event_id, flush, arrival_pos, emit_pos, arrival_pos <> emit_pos AS reordered FROM (
  SELECT *, row_number() OVER (PARTITION BY exchange, symbol, flush ORDER BY recv_ms, event_id) AS arrival_pos,
         row_number() OVER (PARTITION BY exchange, symbol, flush ORDER BY exchange_ms, event_id) AS emit_pos
  FROM (SELECT *, recv_ms // {12 * HOUR} AS flush FROM pk WHERE stage = 'post_receive'))""")
def _(spark, d):
    out = q.reorder_by_event_time(view(spark, d, "fx_packets").filter("stage = 'post_receive'"), 12 * HOUR)
    return out.select("exchange", "symbol", "event_id", "flush", "arrival_pos", "emit_pos", "reordered")


@query("merge_venue_streams", duck("fx_trades") + """
SELECT trade_id, exchange, symbol, ts_us, price, CASE WHEN exchange = 'okx' THEN NULL ELSE quantity END AS quantity FROM fx_trades""")
def _(spark, d):
    rows = view(spark, d, "fx_trades").select("trade_id", "exchange", "symbol", "ts_us", "price", "quantity")
    per = [rows.filter(F.col("exchange") == v) for v in ("binance", "bybit")]
    return q.merge_venue_streams(*per, rows.filter("exchange = 'okx'").drop("quantity"))
