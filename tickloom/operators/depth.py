"""Depth, imbalance and feature operators over books, one row per book.

A book either has its levels as arrays `bids` and `asks`, best first, or comes from `operators.replay` with the measures it
was asked for; a measure that is there is taken, else it is computed from the arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import book as bk
from tickloom.functions.ratios import imbalance, ratio, where
from tickloom.operators.replay import band_name
from tickloom.plans.ordered import chunk_of, ffill, prev, scan
from tickloom.plans.sliding import greatest, least, moves, rows, sliding, spread, total

KEY = ["exchange", "symbol"]


class Measures:
    """Columns over a frame of books."""

    def __init__(self, books: DataFrame):
        self.columns = set(books.columns)

    def best(self, side: str, field: str) -> Column:
        name = {"price": f"best_{side[:-1]}", "quantity": f"{side[:-1]}_qty"}[field]
        return F.col(name) if name in self.columns else bk.best(side, field)

    def mid(self) -> Column:
        return (self.best("bids", "price") + self.best("asks", "price")) / 2

    def count(self, side: str) -> Column:
        name = f"{side[:-1]}_levels"
        return F.col(name) if name in self.columns else F.size(side)

    def both_sides(self) -> Column:
        return (self.count("bids") > 0) & (self.count("asks") > 0)

    def within(self, side: str, bps: float, value) -> Column:
        """Sum over the levels no further than bps from the mid, 0 without two sides."""
        name = f"{side[:-1]}_{'volume' if value is bk.qty else 'notional'}_{band_name(bps)}"
        if name in self.columns:
            return F.col(name)
        return F.when(bk.both_sides(), bk.total(bk.within(side, bps), value)).otherwise(F.lit(0.0))

    def wap(self, bps: float) -> Column:
        """Average price weighted by quantity within the depth, NULL without volume."""
        depth = bps if bps > 0 else 10.0
        value = self.within("bids", depth, bk.notional) + self.within("asks", depth, bk.notional)
        volume = self.within("bids", depth, bk.qty) + self.within("asks", depth, bk.qty)
        return F.when(self.both_sides() & (volume > 0), value / volume)

    def liquidity_imbalance(self, bps: float, value=bk.qty) -> Column:
        return F.when(self.both_sides(), imbalance(self.within("bids", bps, value), self.within("asks", bps, value)))

    def queue_imbalance_levels(self) -> Column:
        return imbalance(self.count("bids").cast("double"), self.count("asks").cast("double"))


def top_of_book(books: DataFrame) -> DataFrame:
    m = Measures(books)
    bid, ask, centre = m.best("bids", "price"), m.best("asks", "price"), m.mid()
    return books.withColumns({
        "best_bid": bid, "bid_qty": m.best("bids", "quantity"), "best_ask": ask,
        "ask_qty": m.best("asks", "quantity"), "mid": centre, "spread": ask - bid,
        "spread_bps": ratio(ask - bid, centre) * 10_000,
    })


def truncate_depth(books: DataFrame, n: int) -> DataFrame:
    return books.withColumns({"bids": bk.top("bids", n), "asks": bk.top("asks", n)})


def top_levels(books: DataFrame, n: int) -> DataFrame:
    """One row per level of the best n on each side, rank 1 being the best."""
    def rows(side: str) -> Column:
        return F.transform(bk.top(side, n), lambda lv, i: F.struct(
            F.lit(side[:-1]).alias("side"), (i + 1).cast("long").alias("rank"), lv["price"].alias("price"),
            lv["quantity"].alias("quantity"),
        ))

    return books.select(*KEY, "seq", F.inline(F.concat(rows("bids"), rows("asks"))))


def wap_depth(books: DataFrame, depth_bps: float = 10) -> DataFrame:
    return books.withColumn("wap", Measures(books).wap(depth_bps))


def volume_at_depth(books: DataFrame, depths_bps: tuple[int, ...] = (10, 20)) -> DataFrame:
    m = Measures(books)
    return books.withColumns({
        f"{side[:-1]}_volume_{band_name(d)}": m.within(side, d, bk.qty) for d in depths_bps for side in ("bids", "asks")
    })


def book_imbalance(books: DataFrame) -> DataFrame:
    m = Measures(books)
    return books.withColumn("book_imbalance", imbalance(m.best("bids", "quantity"), m.best("asks", "quantity")))


def liquidity_imbalance_qty(books: DataFrame, depth_bps: float = 10) -> DataFrame:
    return books.withColumn("liquidity_imbalance", Measures(books).liquidity_imbalance(depth_bps, bk.qty))


def liquidity_imbalance_notional(books: DataFrame, depth_bps: float = 20) -> DataFrame:
    return books.withColumn("liquidity_imbalance", Measures(books).liquidity_imbalance(depth_bps, bk.notional))


def queue_imbalance_levels(books: DataFrame) -> DataFrame:
    return books.withColumn("queue_imbalance", Measures(books).queue_imbalance_levels())


def queue_imbalance_top5(books: DataFrame, n: int = 5) -> DataFrame:
    return books.withColumn("queue_imbalance", bk.queue_imbalance_top(n))


def volume_weighted_imbalance(books: DataFrame, levels: int) -> DataFrame:
    return books.withColumn("volume_weighted_imbalance", bk.volume_weighted_imbalance(levels))


def pressure_imbalance(books: DataFrame, depth: int = 10) -> DataFrame:
    return books.withColumn("pressure_imbalance", bk.pressure_imbalance(depth))


def asof_book_lag(
    books: DataFrame, lags_ms: tuple[int, ...] = (100, 200, 300), values: tuple[str, ...] = ("wap",),
    chunk_us: int = 60_000_000,
) -> DataFrame:
    """`values` of the latest book at or before ts - lag, as `<value>_<lag>ms`, per lag.

    Every book emits itself and one bare probe per lag, and one forward fill answers all probes;
    carry thin columns, not level arrays.
    """
    now = F.struct(F.lit(0).cast("long").alias("lag"), F.lit(0).alias("tag"))
    marks = F.array(now, *[F.struct(F.lit(lag).cast("long").alias("lag"), F.lit(1).alias("tag")) for lag in lags_ms])
    rest = [c for c in books.columns if c not in (*KEY, "seq")]
    book = F.struct(*rest)
    rows = books.withColumn("_m", F.explode(marks)).select(
        *KEY, "seq", F.col("_m.lag").alias("_lag"), F.col("_m.tag").alias("_tag"),
        (F.col("ts_us") - F.col("_m.lag") * 1000).alias("_at"), F.when(F.col("_m.tag") == 0, book).alias("_b"),
    )
    found = scan(
        rows, KEY, ["_at", "_tag", "seq"], chunk_of("_at", chunk_us),
        _past=ffill(F.when(F.col("_tag") == 0, F.struct(*[F.col(f"_b.{v}").alias(v) for v in values]))),
    )
    picks = [
        F.max(F.when((F.col("_tag") == 1) & (F.col("_lag") == lag), F.col(f"_past.{v}"))).alias(f"{v}_{lag}ms")
        for lag in lags_ms for v in values
    ]
    wide = found.groupBy(*KEY, "seq").agg(F.first("_b", ignorenulls=True).alias("_b"), *picks)
    return wide.select(*KEY, "seq", "_b.*", *[f"{v}_{lag}ms" for lag in lags_ms for v in values])


def asof_trades_to_books(
    books: DataFrame, trades: DataFrame, window_us: int, order: tuple[str, ...] = ("trade_id",),
    chunk_us: int | None = None,
) -> DataFrame:
    """Trade-window state at each book: counts, quantities and notionals by side and the up /
    down moves of the trades inside [book ts - window, book ts].

    Books and trades are one tagged stream; books keep their columns, trades only add up. A move is one from trade to trade
    inside the window, so no trade is asked for the one before it but where the windows are.
    """
    width = chunk_us or 4 * window_us
    payload = F.struct(*[F.col(c) for c in books.columns])
    probes = books.select(*KEY, "ts_us", payload.alias("_book"))
    ticks = trades.select(*KEY, "ts_us", "side", "price", "quantity", F.struct("ts_us", *order).alias("_pos"))
    merged = probes.unionByName(ticks, allowMissingColumns=True)
    is_trade, buy, sell = F.col("_pos").isNotNull(), F.col("side") == "buy", F.col("side") == "sell"
    notional = F.col("price") * F.col("quantity")
    up, down = moves(F.col("price"), is_trade)
    state = sliding(
        merged, KEY, "ts_us", window_us, width, ["_pos"], F.col("_book").isNotNull(), ["_book"], trades=rows(is_trade), buys=rows(buy), sells=rows(sell),
        buy_qty=total(where(buy, F.col("quantity"))), sell_qty=total(where(sell, F.col("quantity"))), buy_notional=total(where(buy, notional)),
        sell_notional=total(where(sell, notional)), up_moves=up, down_moves=down,
    )
    return state.select(
        "_book.*", "trades", "buys", "sells", "buy_qty", "sell_qty", "buy_notional", "sell_notional", "up_moves", "down_moves",
    )


def wap_momentum(books: DataFrame, lag_ms: int, depth_bps: float = 10, chunk_us: int = 60_000_000) -> DataFrame:
    thin = books.select(*KEY, "seq", "ts_us", Measures(books).wap(depth_bps).alias("wap"))
    out = asof_book_lag(thin, (lag_ms,), ("wap",), chunk_us)
    past = F.col(f"wap_{lag_ms}ms")
    return out.withColumn("wap_momentum", F.when(past > 0, (F.col("wap") - past) / past))


def wap_rolling_stats(books: DataFrame, window_us: int, depth_bps: float = 10) -> DataFrame:
    """Mean, population deviation, extremes, count and z-score of the WAP over the window."""
    thin = books.select(*KEY, "seq", "ts_us", Measures(books).wap(depth_bps).alias("wap"))
    value = F.col("wap")
    out = sliding(
        thin, KEY, "ts_us", window_us, 4 * window_us, wap_mean=total(value), wap_std=spread(value), wap_min=least(value), wap_max=greatest(value),
        wap_count=rows(value.isNotNull())).withColumn("wap_mean", F.col("wap_mean") / F.col("wap_count"))
    z = F.when(F.col("wap_std") > 1e-9, (F.col("wap") - F.col("wap_mean")) / F.col("wap_std"))
    return out.withColumn("wap_zscore", z)


_PRESETS = {
    "lookback": {"liquidity": (10, bk.qty), "queue": Measures.queue_imbalance_levels, "window_us": 1_000_000},
    "engine": {"liquidity": (20, bk.notional), "queue": lambda m: bk.queue_imbalance_top(), "window_us": 15_000_000},
}
#: What `features` reads of replayed books: `replayed(levels, chunk, **NEEDS)`.
NEEDS = {"bands": (10, 20), "depth": 5}
LAGS_MS = (100, 200, 300)


def features(
    books: DataFrame, trades: DataFrame, order_flow: DataFrame | None = None, preset: str = "lookback",
    window_us: int | None = None, lags_ms: tuple[int, ...] = LAGS_MS, order: tuple[str, ...] = ("trade_id",),
    chunk_us: int | None = None,
) -> DataFrame:
    """The 16-column feature vector per book.

    `lookback`: quantity based, order-flow imbalance from order events if given (a frame of
    exchange, symbol, seq, order_flow_imbalance). `engine`: notional based, order-flow
    imbalance from the trades of the window. Level arrays are reduced to numbers first, so
    only thin rows are shuffled afterwards.
    """
    spec = _PRESETS[preset]
    width = window_us or spec["window_us"]
    depth, value = spec["liquidity"]
    m = Measures(books)
    bid, ask, centre = m.best("bids", "price"), m.best("asks", "price"), m.mid()
    thin = books.select(
        *KEY, "seq", "ts_us", m.wap(10).alias("wap"),
        imbalance(m.best("bids", "quantity"), m.best("asks", "quantity")).alias("order_book_imbalance"),
        m.liquidity_imbalance(depth, value).alias("liquidity_imbalance"), spec["queue"](m).alias("queue_imbalance"),
        (ask - bid).alias("spread"), (ratio(ask - bid, centre) * 10_000).alias("spread_bps"),
        *[m.within(s, d, bk.qty).alias(f"{s[:-1]}_volume_{d}bps") for d in (10, 20) for s in ("bids", "asks")],
    )
    lagged = asof_book_lag(thin, lags_ms, ("wap",), chunk_us or 4 * width)
    flow = asof_trades_to_books(lagged, trades, width, order, chunk_us)
    buys, sells = (("buy_qty", "sell_qty") if preset == "lookback" else ("buy_notional", "sell_notional"))
    moves = ("buys", "sells") if preset == "lookback" else ("up_moves", "down_moves")
    net = imbalance(F.col(buys), F.col(sells))
    out = flow.withColumns({
        "trade_flow_imbalance": net,
        "tick_flow_imbalance": imbalance(F.col(moves[0]).cast("double"), F.col(moves[1]).cast("double")),
    })
    if preset == "engine":
        out = out.withColumn("order_flow_imbalance", net)
    elif order_flow is not None:
        out = out.join(order_flow.select(*KEY, "seq", "order_flow_imbalance"), [*KEY, "seq"], "left")
    else:
        out = out.withColumn("order_flow_imbalance", F.lit(None).cast("double"))
    return out.select(
        *KEY, "seq", "ts_us", F.col("wap").alias("wap_0ms"),
        *[F.col(f"wap_{lag}ms").alias(f"wap_lag{i + 1}") for i, lag in enumerate(lags_ms)],
        "order_flow_imbalance", "order_book_imbalance", "liquidity_imbalance", "queue_imbalance",
        "tick_flow_imbalance", "trade_flow_imbalance", "spread", "spread_bps", "bid_volume_10bps", "ask_volume_10bps",
        "bid_volume_20bps", "ask_volume_20bps",
    )


def signals(features_df: DataFrame, threshold: float = 0.3, min_strength: float = 0.5, min_confidence: float = 0.6):
    """Signals where the order-flow imbalance is beyond the threshold, and the order they call for."""
    ofi = F.col("order_flow_imbalance")
    fired = features_df.filter(F.abs(ofi) > threshold)
    act = (F.col("strength") > min_strength) & (F.col("confidence") > min_confidence)
    return fired.withColumns({
        "signal_type": F.when(ofi > 0, "Momentum").otherwise("MeanReversion"), "strength": F.abs(ofi),
        "confidence": F.lit(0.7),
    }).withColumn(
        "order_side", F.when(act, F.when(F.col("signal_type") == "Momentum", "buy").otherwise("sell"))
    )
