"""Trade-flow features over a trailing time window ending at each trade.

All of them are range frames on `ts_us`, evaluated by `plans.sliding`: rows are dealt by key and
time chunk with a halo of one window length, so a hot symbol is spread over as many tasks
as it has chunks, and the cost of a row does not depend on how full its window is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.ratios import imbalance, ratio, signed, where
from tickloom.operators.accepted import LastAccepted
from tickloom.plans.ordered import chunk_of, cummax, prev, scan
from tickloom.plans.sliding import Measure, earliest, rows, sliding, total, upper_part
from tickloom.plans.streamfold import streamed_fold

KEY = ["exchange", "symbol"]
CHUNKS_PER_WINDOW = 4


def _buy() -> Column:
    return F.col("side") == "buy"


def _sell() -> Column:
    return F.col("side") == "sell"


def _notional() -> Column:
    return F.col("price") * F.col("quantity")


def windowed(trades: DataFrame, window_us: int, keys=KEY, chunk_us: int | None = None, **measures: Measure) -> DataFrame:
    """Add measures over the trailing window of each trade."""
    order = [c for c in ("trade_id",) if c in trades.columns]
    return sliding(trades, list(keys), "ts_us", window_us, chunk_us or CHUNKS_PER_WINDOW * window_us, order, **measures)


def tick_flow_by_side(trades: DataFrame, window_us: int = 1_000_000) -> DataFrame:
    out = windowed(trades, window_us, _b=rows(_buy()), _s=rows(_sell()), _n=rows())
    return out.withColumn("tick_flow_imbalance", (F.col("_b") - F.col("_s")) / F.col("_n")).drop("_b", "_s", "_n")


def tick_flow_updown(trades: DataFrame, window_us: int = 15_000_000) -> DataFrame:
    """(up - down) / (up + down) of consecutive moves inside the window.

    The first trade of a window has its predecessor outside, so its own move is taken off.
    """
    moved = scan(trades, KEY, ["ts_us", "trade_id"], chunk_of("ts_us", CHUNKS_PER_WINDOW * window_us), _p=prev(F.col("price")))
    move = F.coalesce(F.signum(F.col("price") - F.col("_p")), F.lit(0.0))
    up, down = where(move > 0, F.lit(1.0)), where(move < 0, F.lit(1.0))
    out = windowed(moved, window_us, _u=total(up), _d=total(down), _fu=earliest(up), _fd=earliest(down)).withColumns(
        {"up": F.col("_u") - F.col("_fu"), "down": F.col("_d") - F.col("_fd")})
    return out.withColumn("tick_flow_imbalance", imbalance(F.col("up"), F.col("down"))).drop("_p", "_u", "_d", "_fu", "_fd")


def _side_flow(trades: DataFrame, window_us: int, amount: Column, name: str) -> DataFrame:
    out = windowed(trades, window_us, _b=total(where(_buy(), amount)), _s=total(where(_sell(), amount)))
    return out.withColumn(name, imbalance(F.col("_b"), F.col("_s"))).drop("_b", "_s")


def trade_flow_qty(trades: DataFrame, window_us: int = 1_000_000) -> DataFrame:
    return _side_flow(trades, window_us, F.col("quantity"), "trade_flow_imbalance")


def trade_flow_notional(trades: DataFrame, window_us: int = 15_000_000) -> DataFrame:
    return _side_flow(trades, window_us, _notional(), "trade_flow_imbalance")


def order_flow_imbalance_trades(trades: DataFrame, window_us: int = 15_000_000) -> DataFrame:
    """Signed notional of the recent trades over their total notional."""
    out = windowed(trades, window_us, _net=total(signed(F.col("side"), _notional())), _all=total(_notional()))
    return out.withColumn("order_flow_imbalance", ratio(F.col("_net"), F.col("_all"))).drop("_net", "_all")


def rolling_vwap(trades: DataFrame, window_us: int) -> DataFrame:
    out = windowed(trades, window_us, _v=total(_notional()), _q=total(F.col("quantity")))
    return out.withColumn("vwap", ratio(F.col("_v"), F.col("_q"))).drop("_v", "_q")


def trade_intensity(trades: DataFrame, window_us: int) -> DataFrame:
    out = windowed(trades, window_us, _n=rows())
    return out.withColumn("trades_per_second", F.col("_n") / F.lit(window_us / 1_000_000)).drop("_n")


def large_trade_imbalance(trades: DataFrame, window_us: int, pct: float) -> DataFrame:
    """Side imbalance among trades at or above the pct-quantile size of their window."""
    size, net, both = upper_part(signed(F.col("side"), F.col("quantity")), pct)
    out = windowed(trades.filter(F.col("quantity").isNotNull()), window_us, size_threshold=size, _net=net, _all=both)
    return out.withColumn("large_trade_imbalance", ratio(F.col("_net"), F.col("_all"))).drop("_net", "_all")


def price_momentum(trades: DataFrame, fast_us: int, slow_us: int) -> DataFrame:
    """(fast VWAP - slow VWAP) / slow VWAP; both frames share one exchange."""
    sums = {f"_{n}{w}": total(v, w) for n, v in (("v", _notional()), ("q", F.col("quantity"))) for w in (fast_us, slow_us)}
    out = windowed(trades, max(fast_us, slow_us), **sums)
    for name, w in (("fast_vwap", fast_us), ("slow_vwap", slow_us)):
        out = out.withColumn(name, ratio(F.col(f"_v{w}"), F.col(f"_q{w}")))
    change = ratio(F.col("fast_vwap") - F.col("slow_vwap"), F.col("slow_vwap"))
    return out.withColumn("price_momentum", change).drop(*sums)


def event_history(
    df: DataFrame, lookback_ms: int | None = None, last_n: int | None = 10_000, order: str = "trade_id",
    chunk_us: int = 86_400_000_000,
) -> DataFrame:
    """Rows a bounded history would still hold: within the lookback of the newest row of
    the key, and among its last N rows."""
    newest = df.groupBy(*KEY).agg(F.max("ts_us").alias("_newest"), F.count(F.lit(1)).alias("_total"))
    out = df
    if last_n is not None:
        from tickloom.plans.ordered import cumsum

        out = scan(out, KEY, ["ts_us", order], chunk_of("ts_us", chunk_us), _nth=cumsum(F.lit(1)))
    out = out.join(newest, KEY)
    if lookback_ms is not None:
        out = out.filter(F.col("ts_us") >= F.col("_newest") - F.lit(lookback_ms * 1000))
    if last_n is not None:
        out = out.filter(F.col("_nth") > F.col("_total") - F.lit(last_n)).drop("_nth")
    return out.drop("_newest", "_total")


def dedupe_trades(trades: DataFrame, keys: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """First row per key; with a watermark the streaming form bounded in state."""
    if watermark:
        return trades.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
    return trades.dropDuplicates(keys)


def trade_validation(
    trades: DataFrame, max_change_pct: float, max_stale_ms: int, as_of: Column, order: str = "trade_id",
    chunk_us: int = 86_400_000_000,
) -> DataFrame:
    """First failing check of each trade, NULL when it passes.

    Times compare with the newest time of the key so far, prices with the last accepted price: one whose trade passed every
    check before and was no outlier itself.
    """
    arrival = "arrival" if "arrival" in trades.columns else "ts_us"
    chunk = chunk_of(arrival, chunk_us)
    seen = scan(trades, KEY, [arrival, order], chunk, _last_ts=cummax(F.col("ts_us"), "rows_before"))
    early = (
        F.when(F.col("ts_us") < F.col("_last_ts"), "non_monotonic")
        .when((as_of - F.col("ts_us")) / 1000 > max_stale_ms, "stale")
        .when(F.col("price") <= 0, "invalid_price")
        .when(F.col("quantity") <= 0, "invalid_quantity")
    )
    checked = seen.withColumn("_early", early).drop("_last_ts")
    inputs = {"eligible": F.col("_early").isNull(), "price": F.col("price").cast("double")}
    folded = streamed_fold(checked, KEY, chunk, [arrival, order], inputs, LastAccepted(max_change_pct))
    verdict = F.coalesce(F.col("_early"), F.when(F.col("is_outlier"), "outlier"))
    return folded.withColumn("violation", verdict).drop("_early", "is_outlier", "last_accepted")


def late_rows(
    df: DataFrame, watermark_ms: int, arrival: list[str], event_ms: str = "exchange_ms", keys: list[str] | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Rows behind the running maximum event time of their key by more than the watermark."""
    keys = keys or KEY
    seen = scan(
        df, keys, arrival, chunk if chunk is not None else chunk_of(arrival[0], 86_400_000),
        _max=cummax(F.col(event_ms), "rows_before"),
    )
    late = F.col(event_ms) < F.col("_max") - F.lit(watermark_ms)
    return seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(late, 1)).alias("late_rows"),
        F.max(F.when(late, F.col("_max") - F.col(event_ms))).alias("max_lateness_ms"),
    )
