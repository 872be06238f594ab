"""Operational reports: book builder metrics, health, hourly roll-ups, liveness and fleet state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["exchange", "symbol"]
HOUR_US = 3_600_000_000


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def bucket(ts: str, width_us: int) -> Column:
    return F.floor(F.col(ts) / width_us) * width_us


def book_metrics(updates: DataFrame, window_us: int) -> DataFrame:
    """Builder counters per key and window from flagged updates (is_snapshot, has_gap, missing,
    violation, checksum_ok, bytes). Rows of `builder.builder_states` tell resyncs from gaps, and those that
    succeeded from those given up."""
    v = F.col("violation")
    if "new_resyncs" in updates.columns:
        resyncs = {"resyncs": F.sum("new_resyncs"), "resyncs_ok": F.sum("new_ok"), "resyncs_failed": F.sum("new_failed")}
    else:
        resyncs = {"resyncs": _n(F.col("has_gap"))}
    return updates.groupBy(*KEY, bucket("ts_us", window_us).alias("window_us")).agg(
        F.count(F.lit(1)).alias("updates"), (F.count(F.lit(1)) / F.lit(window_us / 1e6)).alias("updates_per_second"),
        _n(F.col("is_snapshot")).alias("snapshots"), F.sum("bytes").alias("bytes"), _n(F.col("has_gap")).alias("gaps"),
        F.sum("missing").alias("missing"), *[c.alias(n) for n, c in resyncs.items()],
        _n(v == "crossed").alias("crossed"), _n(v.isin("invalid_price", "invalid_quantity")).alias("invalid"),
        _n(v.isin("stale", "non_monotonic")).alias("stale"), _n(~F.col("checksum_ok")).alias("checksum_failures"),
        F.max("ts_us").alias("last_update_us"),
    )


def health_check(metrics: DataFrame, max_update_age_ms: int, as_of: Column) -> DataFrame:
    """Recency, gap rate, error rate and latency checks; overall status and the failed ones.

    `metrics`: last_update_us, gaps, errors, uptime_seconds, p99_latency_us per row.
    """
    age = F.floor((as_of - F.col("last_update_us")) / 1000)
    up = F.col("uptime_seconds")
    per_hour = lambda c: F.when(up > 0, F.col(c) / up * 3600).otherwise(F.lit(0.0))
    rows = metrics.withColumns({
        "update_age_ms": F.coalesce(age, F.lit(9_223_372_036_854_775_807)), "gap_rate": per_hour("gaps"),
        "error_rate": per_hour("errors"),
    })
    old, gaps, errors, slow = F.col("update_age_ms"), F.col("gap_rate"), F.col("error_rate"), F.col("p99_latency_us")
    failed = F.array_compact(F.array(
        F.when(~(old < max_update_age_ms), "Update Recency"), F.when(~(gaps < 10), "Gap Rate"),
        F.when(~(errors < 5), "Error Rate"), F.when(~(slow < 10_000), "Latency"),
    ))
    unhealthy = (old > max_update_age_ms * 2) | (gaps > 100) | (errors > 50)
    degraded = (old > max_update_age_ms) | (gaps > 10) | (errors > 5) | (slow > 50_000)
    return rows.withColumns({
        "status": F.when(unhealthy, "Unhealthy").when(degraded, "Degraded").otherwise("Healthy"),
        "failed_checks": F.array_join(failed, ", "), "synchronised": old < max_update_age_ms,
    })


def ops_hourly(conn: DataFrame, perf: DataFrame, err: DataFrame, stats: DataFrame) -> DataFrame:
    """Hourly roll-up of the four log tables per exchange, with a row over all exchanges.

    The tables are unioned into one tagged stream and aggregated once, which gives the result of
    full outer joins of four aggregates with one shuffle.
    """
    def part(df: DataFrame, **values: Column) -> DataFrame:
        return df.select("exchange", bucket("ts_us", HOUR_US).alias("hour_us"), *[v.alias(n) for n, v in values.items()])

    down = F.col("event_type") == "disconnected"
    rows = part(stats, messages=F.col("messages_processed"), drops=F.col("dropped_count"))
    rows = rows.unionByName(part(err.filter("level = 'ERROR'"), error=F.lit(1)), allowMissingColumns=True)
    rows = rows.unionByName(part(perf, cpu=F.col("cpu_usage"), mem=F.col("memory_mb"), latency=F.col("latency_ms")), allowMissingColumns=True)
    rows = rows.unionByName(part(conn, conn=F.lit(1), lost=F.when(down, 1).otherwise(0)), allowMissingColumns=True)
    return rows.rollup("hour_us", "exchange").agg(
        F.grouping_id().cast("long").alias("gid"), F.sum("messages").alias("total_messages"), F.count("error").alias("total_errors"),
        F.avg("cpu").alias("avg_cpu_usage"), F.avg("mem").alias("avg_memory_mb"), F.max("latency").alias("max_latency_ms"),
        F.sum("lost").alias("connection_drops"), F.sum("drops").alias("dropped_messages"),
        ((F.count("conn") - F.sum("lost")) / F.nullif(F.count("conn"), F.lit(0)) * 100).alias("uptime_percent"),
    ).filter("gid < 3")


def ops_monitoring_queries(tables: dict[str, DataFrame], as_of_us: int) -> DataFrame:
    """The four operator questions at a time, as rows (question, exchange, detail, value):
    connection events of the last hour, 5-minute means, errors of the last hour, messages per
    second over the last minute."""
    def since(name: str, width_us: int) -> DataFrame:
        return tables[name].filter((F.col("ts_us") > as_of_us - width_us) & (F.col("ts_us") <= as_of_us))

    minute = 60_000_000

    def rows(df: DataFrame, question: str, detail: Column, value: Column) -> DataFrame:
        return df.select(F.lit(question).alias("question"), "exchange", detail.alias("detail"), value.cast("double").alias("value"))

    events = rows(since("connection", HOUR_US).groupBy("exchange", "event_type").agg(F.count(F.lit(1)).alias("v")),
                  "recent_connections", F.col("event_type"), F.col("v"))
    perf = since("performance", 5 * minute).groupBy("exchange").agg(
        F.avg("cpu_usage").alias("cpu_usage"), F.avg("memory_mb").alias("memory_mb"), F.avg("latency_ms").alias("latency_ms"))
    current = perf.select("exchange", F.expr(
        "stack(3, 'cpu_usage', cpu_usage, 'memory_mb', memory_mb, 'latency_ms', latency_ms) AS (m, v)"))
    errors = since("error", HOUR_US).groupBy("exchange").agg(F.count(F.lit(1)).alias("v"))
    rate = since("stats", minute).groupBy("exchange", "data_type").agg((F.sum("messages_processed") / 60).alias("v"))
    out = events.unionByName(rows(current, "current_performance", F.col("m"), F.col("v")))
    out = out.unionByName(rows(errors, "error_counts", F.lit("errors"), F.col("v")))
    return out.unionByName(rows(rate, "processing_rate", F.col("data_type"), F.col("v")))


def log_metrics(logs: DataFrame, interval: str = "60 seconds") -> DataFrame:
    """Errors, warnings, mean latency from metadata, drops and reconnects per exchange and interval.

    Works on streams too once the caller has set a watermark on `ts`.
    """
    text = F.lower("message")
    latency = F.try_element_at("metadata", F.lit("latency_ms")).try_cast("double")
    return logs.groupBy("exchange", F.window("ts", interval).alias("w")).agg(
        _n(F.col("level") == "ERROR").alias("errors"), _n(F.col("level") == "WARN").alias("warnings"),
        F.avg(latency).alias("avg_latency_ms"), _n(text.contains("dropped")).alias("drops"),
        _n(text.contains("reconnect")).alias("reconnects"), F.count(F.lit(1)).alias("entries"),
    ).select("exchange", F.unix_micros("w.start").alias("window_us"), "errors", "warnings", "avg_latency_ms", "drops", "reconnects", "entries")


# Connection event, the status it implies, and whether it carries an error text.
CONNECTION_STATUS = {
    "connected": "success", "disconnected": "failure", "reconnecting": "pending", "rate_limited": "failure", "error": "failure",
}


def connection_status(df: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in CONNECTION_STATUS.items() for x in kv])
    return df.withColumn("status", F.try_element_at(table, F.col("event_type")))


def connection_summary(df: DataFrame) -> DataFrame:
    """Connect, disconnect and reconnect totals and the last error per exchange."""
    kind = F.col("event_type")
    bad = F.when(F.col("error_msg").isNotNull(), F.struct("ts_us", "event_id"))
    return connection_status(df).groupBy("exchange").agg(
        _n(kind == "connected").alias("connected"), _n(kind == "disconnected").alias("disconnected"),
        _n(kind == "reconnecting").alias("reconnects"), _n(F.col("status") == "failure").alias("failures"),
        F.max_by("error_msg", bad).alias("last_error"), F.max(F.when(F.col("error_msg").isNotNull(), F.col("ts_us"))).alias("last_error_us"),
    )


def feed_liveness(trades: DataFrame, books: DataFrame, as_of_us: int, live_ms: int = 5_000, delayed_ms: int = 30_000) -> DataFrame:
    """Trades, books, message rate and data age per exchange: LIVE, DELAYED or STALE."""
    both = trades.select("exchange", "ts_us", F.lit(1).alias("t"), F.lit(0).alias("b")).unionByName(
        books.select("exchange", "ts_us", F.lit(0).alias("t"), F.lit(1).alias("b"))).filter(F.col("ts_us") <= as_of_us)
    per = both.groupBy("exchange").agg(
        F.sum("t").alias("trades"), F.sum("b").alias("books"), F.min("ts_us").alias("_first"), F.max("ts_us").alias("last_us"))
    age = F.floor((F.lit(as_of_us) - F.col("last_us")) / 1000)
    seconds = (F.lit(as_of_us) - F.col("_first")) / 1e6
    return per.withColumns({
        "age_ms": age, "messages_per_second": F.when(seconds > 0, (F.col("trades") + F.col("books")) / seconds),
    }).withColumn("status", F.when(F.col("age_ms") < live_ms, "LIVE").when(F.col("age_ms") < delayed_ms, "DELAYED").otherwise("STALE")).drop("_first")


def aging_report(metrics: DataFrame, run_id: str | None = None, max_growth_mb: float = 100, max_cpu: float = 80, max_reconnects: int = 10):
    """Mean CPU, memory growth from first to last sample and reconnects per test run, with verdicts."""
    rows = metrics if run_id is None else metrics.filter(F.col("run_id") == run_id)
    at = F.struct("ts_us", "event_id")
    out = rows.groupBy("run_id").agg(
        F.avg("cpu_usage").alias("avg_cpu"), F.min_by("memory_mb", at).alias("first_memory_mb"),
        F.max_by("memory_mb", at).alias("last_memory_mb"), _n(F.col("event_type") == "reconnecting").alias("reconnects"))
    out = out.withColumn("memory_growth_mb", F.col("last_memory_mb") - F.col("first_memory_mb"))
    return out.withColumns({
        "memory_ok": F.col("memory_growth_mb") <= max_growth_mb, "cpu_ok": F.col("avg_cpu") <= max_cpu,
        "reconnects_ok": F.col("reconnects") <= max_reconnects,
    })


def processing_fleet_totals(df: DataFrame, max_cpu: float = 80, max_latency_ms: float = 50) -> DataFrame:
    """Fleet totals over the latest metrics of each exchange, and which exchanges need attention."""
    last = df.groupBy("exchange").agg(F.max_by(
        F.struct("cpu_usage", "memory_mb", "data_rate", "websocket_count", "latency_ms"), F.struct("ts_us", "event_id")).alias("m")).select(
        "exchange", "m.*")
    issue = F.when(F.col("cpu_usage") > max_cpu, F.concat("exchange", F.lit(": high cpu"))).when(
        F.col("latency_ms") > max_latency_ms, F.concat("exchange", F.lit(": high latency")))
    return last.agg(
        F.count(F.lit(1)).alias("exchanges"), F.avg("cpu_usage").alias("mean_cpu"), F.sum("memory_mb").alias("memory_mb"),
        F.sum("data_rate").alias("data_rate"), F.sum("websocket_count").alias("connections"),
        F.array_join(F.sort_array(F.collect_list(issue)), "; ").alias("issues"))


def market_totals(trades: DataFrame, books: DataFrame) -> DataFrame:
    """Trades and books per exchange with a total row."""
    both = trades.select("exchange", F.lit(1).alias("t"), F.lit(0).alias("b")).unionByName(
        books.select("exchange", F.lit(0).alias("t"), F.lit(1).alias("b")))
    return both.rollup("exchange").agg(F.sum("t").alias("trades"), F.sum("b").alias("books"), F.count(F.lit(1)).alias("messages"))
