"""Streaming operators: DataFrame in, DataFrame out, plus the runner used for bounded inputs."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import scalars as s
from tickloom.functions.ratios import imbalance, where
from tickloom.operators.builder import machine
from tickloom.session import STATE_STORE, shared_dir
from tickloom.streaming import processors as p

KEY = ["exchange", "symbol"]
SORTED_BATCHES = {"spark.sql.streaming.unsupportedOperationCheck": "false"}  # for queries over `_keyed` operators


def stream_features_tumbling(trades: DataFrame, size: str, slide: str | None = None, watermark: str = "10 seconds"):
    """VWAP, notional imbalance and intensity per key and tumbling or sliding window."""
    notional = F.col("price") * F.col("quantity")
    frame = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = trades.withWatermark("ts", watermark).groupBy(*KEY, frame.alias("w")).agg(
        F.sum(notional).alias("_v"), F.sum("quantity").alias("_q"),
        F.sum(where(F.col("side") == "buy", notional)).alias("_b"), F.sum(where(F.col("side") == "sell", notional)).alias("_s"),
        F.count(F.lit(1)).alias("trades"),
    )
    start, end = F.unix_micros("w.start"), F.unix_micros("w.end")
    return out.select(
        *KEY, start.alias("start_us"), end.alias("end_us"), "trades", (F.col("_v") / F.col("_q")).alias("vwap"),
        imbalance(F.col("_b"), F.col("_s")).alias("trade_flow_imbalance"),
        (F.col("trades") / ((end - start) / 1e6)).alias("trades_per_second"),
    )


def stream_sessions(events: DataFrame, gap: str, watermark: str, keys: list[str] | None = None) -> DataFrame:
    """Sessions of activity per venue: start, end, number of events and errors."""
    keys = keys or ["exchange"]
    out = events.withWatermark("ts", watermark).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("level") == "ERROR", 1)).alias("errors"))
    return out.select(*keys, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "events", "errors")


def _keyed(df: DataFrame, keys: list[str], processor, time_mode: str = "None") -> DataFrame:
    """Rows reach the processor in its order: dealt as the state is, sorted by Spark inside each micro-batch and streamed to it.

    The sort is one of each micro-batch alone. Spark refuses any sort of a stream unless told otherwise (`SORTED_BATCHES`).
    """
    if processor.order:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        along = [F.col(c).asc_nulls_last() for c in processor.order if c not in keys]
        df = df.repartition(parts, *keys).sortWithinPartitions(*keys, *along)
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.schema, outputMode="Append", timeMode=time_mode)


def stream_book_builder(
    levels: DataFrame, snapshot_timeout_s: float = 30, order: tuple[str, ...] = ("pos",), max_attempts: int = 5, backoff_ms: int = 100,
    error_wait_s: float = 5, max_buffer: int = 10_000, timers: bool = False,
) -> DataFrame:
    """`order` places the entries of one message; the last entry of a price wins. update_id (default seq), first_update_id,
    checksum_ok, crossed and manual are read where they are. `timers` needs a watermark on event time."""
    rules = machine(snapshot_timeout_s, max_attempts, backoff_ms, error_wait_s)
    return _keyed(levels, KEY, p.BookBuilder(rules, order, max_buffer, timers), "EventTime" if timers else "None")


def stream_inversions(packets: DataFrame) -> DataFrame:
    return _keyed(packets, KEY, p.Inversions())


def stream_nbbo(quotes: DataFrame, max_stale_ms: int, ttl_ms: int | None = None) -> DataFrame:
    mode = "ProcessingTime" if ttl_ms else "None"
    return _keyed(quotes, ["symbol"], p.Nbbo(max_stale_ms, ttl_ms), mode)


def stream_positions(fills: DataFrame, order: list[str]) -> DataFrame:
    return _keyed(fills, KEY, p.Positions(order))


def stream_merge_book_sides(packets: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    return _keyed(packets, KEY, p.BookSides(ttl_ms), "ProcessingTime" if ttl_ms else "None")


def stream_reorder(packets: DataFrame, window_ms: int, watermark: str = "0 seconds") -> DataFrame:
    """Source-time order inside each flush window. The window is part of the key, so a busy symbol
    spreads over the state partitions and each state ends with its window."""
    flush = F.floor(F.col("recv_ms") / window_ms)
    timed = packets.withColumns({"recv_ts": F.timestamp_millis("recv_ms"), "flush": flush}).withWatermark("recv_ts", watermark)
    return _keyed(timed, [*KEY, "flush"], p.Reorder(window_ms), "EventTime")


def stream_ops_sink(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None, max_len: int = 800):
    """Log rows appended by table and date. Every micro-batch owns a folder and overwrites it on a
    retry, so a lost executor or driver cannot duplicate rows. Returns the running query."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({
            "message": s.escape_log(s.truncate_log(F.col("message"), max_len)), "date": F.to_date("ts"),
        })
        rows.write.mode("overwrite").partitionBy("table", "date").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available_now(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Process what the source holds now into a table under the shared folder and read it back."""
    root = shared_dir(spark, label)
    values = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, **SORTED_BATCHES}
    with _settings(spark, values):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option(
            "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
