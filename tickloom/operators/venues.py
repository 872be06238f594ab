"""Cross-venue views: latest quote per venue, NBBO, spreads, ratios and staleness.

Latest-row lookups are `max_by` aggregates (combined map-side), never windows; after them a
symbol has one row per venue and the venue pairs below stay that small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.ratios import ratio
from tickloom.plans.ordered import chunk_of
from tickloom.plans.streamfold import Description, Fold, streamed_fold
from tickloom.session import ship_by_value

ship_by_value(__name__)

QUOTE = ["best_bid", "bid_qty", "best_ask", "ask_qty"]


def latest(df: DataFrame, keys: list[str], values: list[str], order: list[str], as_of: int | None = None) -> DataFrame:
    """Last row per key, optionally as of a timestamp."""
    if as_of is not None:
        df = df.filter(F.col("ts_us") <= F.lit(as_of))
    rest = [v for v in values if v not in keys]
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_v")
    )
    return best.select(*keys, "_v.*")


def cross_exchange_pairs(trades: DataFrame, as_of: int | None = None) -> DataFrame:
    """Latest trade of every unordered venue pair of a symbol: absolute and relative spread."""
    last = latest(trades, ["symbol", "exchange"], ["price"], ["ts_us", "trade_id"], as_of)
    a = last.select("symbol", F.col("exchange").alias("exchange1"), F.col("price").alias("price1"))
    b = last.select("symbol", F.col("exchange").alias("exchange2"), F.col("price").alias("price2"))
    gap = F.abs(F.col("price1") - F.col("price2"))
    return (
        a.join(b, "symbol").filter(F.col("exchange1") < F.col("exchange2"))
        .withColumn("spread", gap).withColumn("spread_percent", ratio(gap, F.col("price1")) * 100)
    )


def _pick(df: DataFrame, venue: str, value: str, order: list[str]) -> Column:
    at = F.struct(*[F.col(c) for c in order])
    return F.max_by(F.col(value), F.when(F.col("exchange") == venue, at))


def cross_exchange_spread(quotes: DataFrame, ex1: str, ex2: str) -> DataFrame:
    """bid(ex1) - ask(ex2) per symbol from the latest quotes; one aggregation, no join."""
    wanted = quotes.filter(F.col("exchange").isin(ex1, ex2))
    sides = wanted.groupBy("symbol").agg(
        _pick(wanted, ex1, "best_bid", ["ts_us", "seq"]).alias("bid1"),
        _pick(wanted, ex2, "best_ask", ["ts_us", "seq"]).alias("ask2"),
    )
    return sides.filter(F.col("bid1").isNotNull() & F.col("ask2").isNotNull()).withColumn(
        "spread", F.col("bid1") - F.col("ask2")
    )


def price_ratio(trades: DataFrame, ex1: str, ex2: str) -> DataFrame:
    wanted = trades.filter(F.col("exchange").isin(ex1, ex2))
    sides = wanted.groupBy("symbol").agg(
        _pick(wanted, ex1, "price", ["ts_us", "trade_id"]).alias("price1"),
        _pick(wanted, ex2, "price", ["ts_us", "trade_id"]).alias("price2"),
    )
    return sides.withColumn("ratio", ratio(F.col("price1"), F.col("price2")))


def latest_book_by_exchange(books: DataFrame, symbol: str | None = None) -> DataFrame:
    """Latest top of book of each venue, for symbols quoted on at least two venues."""
    if symbol is not None:
        books = books.filter(F.col("symbol") == symbol)
    last = latest(books, ["symbol", "exchange"], ["ts_us", *QUOTE], ["ts_us", "seq"])
    venues = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return last.withColumn("venues", venues).filter(F.col("venues") >= 2)


def arbitrage_pairs(quotes: DataFrame, as_of: int | None = None) -> DataFrame:
    """Ordered venue pairs where one bid is above the other ask."""
    last = latest(quotes, ["symbol", "exchange"], QUOTE, ["ts_us", "seq"], as_of)
    sell = last.select("symbol", F.col("exchange").alias("sell_venue"), F.col("best_bid").alias("bid"))
    buy = last.select("symbol", F.col("exchange").alias("buy_venue"), F.col("best_ask").alias("ask"))
    crossed = (F.col("sell_venue") != F.col("buy_venue")) & (F.col("bid") > F.col("ask"))
    return sell.join(buy, "symbol").filter(crossed).withColumn("spread", F.col("bid") - F.col("ask"))


def price_ratio_deviation(trades: DataFrame, base: str, as_of: int | None = None) -> DataFrame:
    last = latest(trades, ["symbol", "exchange"], ["price"], ["ts_us", "trade_id"], as_of)
    anchor = last.filter(F.col("exchange") == base).select("symbol", F.col("price").alias("base_price"))
    others = last.filter(F.col("exchange") != base)
    out = others.join(anchor, "symbol").withColumn("ratio", ratio(F.col("base_price"), F.col("price")))
    return out.withColumn("deviation_bps", (F.col("ratio") - 1) * 10_000)


def snapshot_spread_bps(df: DataFrame) -> DataFrame:
    """Spread over bid in bps, mid, and exchange-to-local latency floored at zero."""
    spread = F.when(F.col("best_bid") > 0, (F.col("best_ask") - F.col("best_bid")) / F.col("best_bid") * 10_000)
    return df.withColumns(
        {
            "spread_bps": spread, "mid": (F.col("best_bid") + F.col("best_ask")) / 2,
            "latency_us": F.greatest(F.col("local_ts_us") - F.col("ts_us"), F.lit(0)),
        }
    )


def _derive(df: DataFrame) -> DataFrame:
    bid, ask = F.col("best_bid"), F.col("best_ask")
    crossed = bid >= ask
    return df.filter(bid.isNotNull() & ask.isNotNull() & (bid > 0)).withColumns(
        {
            "mid": (bid + ask) / 2, "spread": ask - bid, "spread_bps": (ask - bid) / ((bid + ask) / 2) * 10_000,
            "validation_rate": F.col("num_exchanges") / F.col("num_checked"), "is_crossed": crossed,
            "is_locked": bid == ask, "arbitrage_profit": F.when(crossed, bid - ask).otherwise(F.lit(0.0)),
        }
    )


class BestPrices(Fold):
    """The best fresh bid and ask over the latest quotes of all venues. A chunk is described by its last quote of each venue."""

    start: dict = {}
    names = ("num_checked", "num_exchanges", "best_bid", "bid_qty", "bid_exchange", "best_ask", "ask_qty", "ask_exchange")
    outputs = (
        "now_num_checked long, now_num_exchanges long, now_best_bid double, now_bid_qty double, now_bid_exchange string, now_best_ask double, "
        "now_ask_qty double, now_ask_exchange string"
    )

    def __init__(self, max_stale_ms: int):
        self.max_stale_ms = max_stale_ms

    def describe(self) -> _LastQuotes:
        return _LastQuotes()

    def advance(self, state: dict, last: dict) -> dict:
        return {**state, **last}

    def step(self, state: dict, exchange: str | None, ts: int, *quote: float | None) -> tuple[dict, tuple]:
        if exchange is not None:
            state = {**state, exchange: (ts, *quote)} if state is self.start else state
            state[exchange] = (ts, *quote)
        fresh = [(venue, q) for venue, q in state.items() if (ts - q[0]) // 1000 <= self.max_stale_ms]
        bids = [(-q[1], venue, q[2]) for venue, q in fresh if q[1] is not None]
        asks = [(q[3], venue, q[4]) for venue, q in fresh if q[3] is not None]
        bid, bid_venue, bid_qty = min(bids, key=lambda b: b[:2]) if bids else (None, None, None)
        ask, ask_venue, ask_qty = min(asks, key=lambda a: a[:2]) if asks else (None, None, None)
        return state, (len(state), len(fresh), None if bid is None else -bid, bid_qty, bid_venue, ask, ask_qty, ask_venue)


class _LastQuotes(Description):
    def __init__(self):
        self.last: dict = {}

    def add(self, exchange: str | None, ts: int, *quote: float | None) -> None:
        if exchange is not None:
            self.last[exchange] = (ts, *quote)

    def result(self) -> dict:
        return self.last


def nbbo(
    quotes: DataFrame, max_stale_ms: int, as_of: int | None = None, mode: str = "continuous",
    chunk_us: int = 86_400_000_000,
) -> DataFrame:
    """National best bid and offer over venues whose latest quote is fresh.

    `snapshot`: one row per symbol as of a time. `continuous`: one row per quote, the state
    just after it: a map from venue to its latest quote, folded by chunks of time, so a hot symbol is split
    and the plan is the same for any number of venues. A quote without a venue has its row but never a best price.
    Ties go to the smallest venue name.
    """
    if mode == "snapshot":
        last = latest(quotes, ["symbol", "exchange"], ["ts_us", *QUOTE], ["ts_us", "seq"], as_of)
        now = F.lit(as_of) if as_of is not None else F.max("ts_us").over(Window.partitionBy("symbol"))
        fresh = F.floor((F.col("_now") - F.col("ts_us")) / 1000) <= max_stale_ms
        rank = F.struct(-F.col("best_bid"), "exchange"), F.struct("best_ask", "exchange")
        top = last.withColumn("_now", now).groupBy("symbol").agg(
            F.max("_now").alias("ts_us"),
            F.count(F.lit(1)).alias("num_checked"), F.count(F.when(fresh, 1)).alias("num_exchanges"),
            F.min_by(F.struct("best_bid", "bid_qty", "exchange"), F.when(fresh, rank[0])).alias("_b"),
            F.min_by(F.struct("best_ask", "ask_qty", "exchange"), F.when(fresh, rank[1])).alias("_a"),
        )
        flat = top.select(
            "symbol", "ts_us", "num_checked", "num_exchanges", "_b.best_bid", "_b.bid_qty",
            F.col("_b.exchange").alias("bid_exchange"), "_a.best_ask", "_a.ask_qty",
            F.col("_a.exchange").alias("ask_exchange"),
        )
        return _derive(flat)

    rows = quotes.select("symbol", "exchange", "ts_us", "seq", *QUOTE)
    inputs = {"exchange": F.col("exchange"), "ts": F.col("ts_us"), **{c: F.col(c).cast("double") for c in QUOTE}}
    walked = streamed_fold(rows, ["symbol"], chunk_of("ts_us", chunk_us), ["ts_us", "seq"], inputs, BestPrices(max_stale_ms))
    flat = walked.select("symbol", "ts_us", "seq", *[F.col(f"now_{c}").alias(c) for c in BestPrices.names])
    return _derive(flat)


def nbbo_statistics(df: DataFrame) -> DataFrame:
    """Spread summary, locked / crossed counts and each venue's share of best bids and asks."""
    totals = df.agg(
        F.countDistinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("computations"),
        F.avg("spread_bps").alias("avg_spread_bps"), F.min("spread_bps").alias("min_spread_bps"),
        F.max("spread_bps").alias("max_spread_bps"), F.count(F.when(F.col("is_locked"), 1)).alias("locked_markets"),
        F.count(F.when(F.col("is_crossed"), 1)).alias("crossed_markets"),
        F.count(F.when(F.col("spread") < 0, 1)).alias("negative_spreads"),
    )
    sides = df.select(F.explode(F.array(
        F.struct(F.col("bid_exchange").alias("venue"), F.lit(1).alias("b"), F.lit(0).alias("a")),
        F.struct(F.col("ask_exchange").alias("venue"), F.lit(0).alias("b"), F.lit(1).alias("a")),
    )).alias("s")).select("s.*")
    shares = sides.groupBy("venue").agg(F.sum("b").alias("best_bid_count"), F.sum("a").alias("best_ask_count"))
    names = totals.columns
    out = shares.withColumn("_t", totals.select(F.struct(*names)).scalar()).select(*shares.columns, "_t.*")
    for side in ("bid", "ask"):
        out = out.withColumn(f"best_{side}_pct", F.col(f"best_{side}_count") / F.col("computations") * 100)
    return out


def stale_books(books: DataFrame, max_stale_ms: int, as_of: int | None = None) -> DataFrame:
    """Books whose last update is older than the limit at `as_of` (default: newest row)."""
    last = books.groupBy("exchange", "symbol").agg(F.max("ts_us").alias("last_ts_us"))
    if as_of is None:
        last = last.withColumn("as_of_us", books.agg(F.max("ts_us")).scalar())
    else:
        last = last.withColumn("as_of_us", F.lit(as_of))
    age = F.floor((F.col("as_of_us") - F.col("last_ts_us")) / 1000)
    return last.withColumn("age_ms", age).filter(F.col("age_ms") > max_stale_ms).drop("as_of_us")
