"""Positions, profit, risk and quoting from recorded fills, orders and mids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.ratios import ratio, signed
from tickloom.operators.folds import average_cost
from tickloom.plans.ordered import asof, chunk_of, cumsum, scan

KEY = ["exchange", "symbol"]
DAY_US = 86_400_000_000


UNITS = 100_000_000
ROWS = 100_000


def position_path(
    fills: DataFrame, order: list[str], chunk_us: int = 30 * DAY_US, keys: list[str] = KEY, units: int = UNITS, rows: int = ROWS,
) -> DataFrame:
    """Every fill with the position after it and what it realised, by average cost.

    A fill against the position first closes it (that part realises profit); what is left
    opens the other way at the fill's price. Quantities count in whole units of 1 / `units`, so 0.1 + 0.2 - 0.3
    is flat; positions of 9.2e18 units and more fail. The path is folded in chunks of `rows` fills and is the same for any.
    """
    unit = F.round(F.col("quantity") * units).cast("long")
    counted = fills.withColumn("_du", signed(F.col("side"), unit))
    counted = scan(counted, keys, order, chunk_of("ts_us", chunk_us), units_after=cumsum(F.col("_du")), nth=cumsum(F.lit(1)))
    counted = counted.withColumn("units_before", F.col("units_after") - F.col("_du"))
    path = average_cost(counted, keys, F.floor(F.col("nth") / rows), order, units)
    return path.withColumns({
        "dq": F.col("_du") / units, "q_before": F.col("units_before") / units, "q_after": F.col("units_after") / units,
        "closed": F.col("closed_units") / units,
    }).drop("_du", "units_before", "units_after", "closed_units")


def positions(fills: DataFrame, order: list[str], chunk_us: int = 30 * DAY_US) -> DataFrame:
    """Final quantity, average entry and realised profit per key."""
    path = position_path(fills, order, chunk_us)
    return path.groupBy(*KEY).agg(
        F.max_by("q_after", "nth").alias("quantity"), F.max_by("avg_after", "nth").alias("avg_price"),
        F.max_by("realised_total", "nth").alias("realised_pnl"), F.max("ts_us").alias("last_ts_us"), F.count(F.lit(1)).alias("fills"),
    )


def exposure(positions_df: DataFrame) -> DataFrame:
    """Total |quantity| x average entry, and how many positions are open."""
    value = F.abs("quantity") * F.col("avg_price")
    return positions_df.agg(
        F.sum(value).alias("total_exposure"), F.count(F.when(F.col("quantity") != 0, 1)).alias("open_positions"))


def open_positions(positions_df: DataFrame) -> DataFrame:
    return positions_df.filter("quantity <> 0")


def performance(path: DataFrame, order: list[str], chunk_us: int = 30 * DAY_US) -> DataFrame:
    """One row over all closing fills: counts, win rate, mean win and loss, total and the lowest
    running total (never above zero)."""
    closing = path.filter(F.col("closed") > 0)
    running = scan(closing, [], order, chunk_of("ts_us", chunk_us), _cum=cumsum(F.col("realised")))
    win, loss = F.col("realised") > 0, F.col("realised") < 0
    out = running.agg(
        F.count(F.lit(1)).alias("total_trades"), F.count(F.when(win, 1)).alias("winning_trades"),
        F.count(F.when(loss, 1)).alias("losing_trades"), F.avg(F.when(win, F.col("realised"))).alias("avg_win"),
        F.avg(F.when(loss, F.col("realised"))).alias("avg_loss"), F.sum("realised").alias("total_pnl"),
        F.least(F.min("_cum"), F.lit(0.0)).alias("max_drawdown"),
    )
    return out.withColumn("win_rate", ratio(F.col("winning_trades"), F.col("total_trades")))


def daily_pnl(path: DataFrame) -> DataFrame:
    day = F.floor(F.col("ts_us") / DAY_US).alias("day")
    return path.filter(F.col("closed") > 0).groupBy(day).agg(
        F.sum("realised").alias("pnl"), F.count(F.lit(1)).alias("trades"))


def risk_audit(
    orders: DataFrame, path: DataFrame, max_position: float, max_daily_loss: float, max_exposure: float,
    chunk_us: int = 30 * DAY_US,
) -> DataFrame:
    """First limit each recorded order breached given the fills up to its time, NULL if none.

    Checked in order: realised loss of the day, position after the order, total exposure.
    The two book-wide series are summed per timestamp before they are accumulated.
    """
    value = F.abs("q_after") * F.col("avg_after") - F.abs("q_before") * F.col("avg_before")
    moves = path.groupBy(*KEY, "ts_us").agg(
        F.sum(value).alias("_dx"), F.sum("realised").alias("_dp"), F.max_by("q_after", "nth").alias("q_after"), F.max("nth").alias("nth"))
    # always so; it has both readers ask for the same columns, so the path is walked once
    moves = moves.filter(F.hash("_dx", "_dp", "q_after", "nth") >= F.lit(-(2**31)))
    series = moves.groupBy("ts_us").agg(F.sum("_dx").alias("_dx"), F.sum("_dp").alias("_dp")).withColumn(
        "_day", F.floor(F.col("ts_us") / DAY_US))
    at = chunk_of("ts_us", chunk_us)
    total = scan(series, [], ["ts_us"], at, _exposure=cumsum(F.col("_dx")))
    today = scan(total, ["_day"], ["ts_us"], at, _pnl=cumsum(F.col("_dp")))
    book = today.select("ts_us", "_exposure", "_pnl", F.col("_day").alias("_pnl_day"))
    held = moves.select(*KEY, "ts_us", "nth", "q_after")

    with_position = asof(orders, held, KEY, "ts_us", "ts_us", ["q_after"], chunk_us, right_tie="nth")
    with_position = with_position.withColumn("position", F.coalesce("matched.q_after", F.lit(0.0))).drop("matched")
    rows = asof(with_position, book, [], "ts_us", "ts_us", ["_exposure", "_pnl", "_pnl_day"], chunk_us)
    same_day = F.col("matched._pnl_day") == F.floor(F.col("ts_us") / DAY_US)
    after = F.col("position") + signed(F.col("side"), F.col("quantity"))
    rows = rows.withColumns({
        "daily_pnl": F.when(same_day, F.col("matched._pnl")).otherwise(F.lit(0.0)),
        "exposure": F.coalesce("matched._exposure", F.lit(0.0)),
    }).drop("matched")
    breach = (
        F.when(F.col("daily_pnl") < -max_daily_loss, "daily_loss").when(F.abs(after) > max_position, "position_size")
        .when(F.col("exposure") > max_exposure, "total_exposure")
    )
    return rows.withColumn("breach", breach)


def orderable_margin(orders: DataFrame, balances: DataFrame, brackets: DataFrame, safety: float = 0.8, asset: str = "USDT"):
    """How many orders of this price and size the account's margin allows.

    Leverage is that of the symbol's first bracket, 1 where unknown.
    """
    cash = balances.filter(F.col("asset") == asset).select("account", F.col("amount").alias("margin"))
    first = brackets.groupBy("symbol").agg(F.min_by("leverage", "bracket").alias("leverage"))
    rows = orders.join(cash, "account", "left").join(first, "symbol", "left")
    rows = rows.withColumns({"margin": F.coalesce("margin", F.lit(0.0)), "leverage": F.coalesce("leverage", F.lit(1.0))})
    per_order = F.col("price") * F.col("size") / F.col("leverage")
    count = F.floor(F.col("margin") * safety / per_order)
    return rows.withColumn("max_orders", F.when(per_order > 0, F.greatest(count, F.lit(0))))


def rate_limit_violations(orders: DataFrame, window_us: int, max_orders: int) -> DataFrame:
    """Orders beyond the limit per account and window."""
    start = (F.floor(F.col("ts_us") / window_us) * window_us).alias("window_us")
    per = orders.groupBy("account", start).agg(F.count(F.lit(1)).alias("orders"))
    return per.filter(F.col("orders") > max_orders).withColumn("excess", F.col("orders") - max_orders)


def latest_order_status(order_log: DataFrame, order: list[str], exchange: str | None = None, symbol: str | None = None) -> DataFrame:
    """Latest response of every order, optionally of one exchange and / or symbol."""
    rows = order_log
    if exchange is not None:
        rows = rows.filter(F.col("exchange") == exchange)
    if symbol is not None:
        rows = rows.filter(F.col("symbol") == symbol)
    last = F.max_by(F.struct("exchange", "symbol", "status", "ts_us"), F.struct(*order)).alias("_r")
    return rows.groupBy("order_id").agg(last).select("order_id", "_r.*")


def _tick(price: Column, tick: float) -> Column:
    return F.round(price / tick) * tick


def quote_ladder(
    mids: DataFrame, spread: float, tick: float, levels: int, min_notional: float = 100, order_size: float = 0.01,
    positions_df: DataFrame | None = None, max_position: float = 0.1, style: str = "balanced",
) -> DataFrame:
    """Bid and ask prices and quantities around each mid.

    `balanced`: prices on the tick grid, quantity up to the minimum notional at three
    decimals; with positions (symbol, quantity) the heavier side gets fewer levels: the count
    shrinks by 0.5 + 0.5 (1 - |skew|), skew = position / max_position within -1..1. An
    optional `max_orders` column of the mids caps the levels at half of it.
    `stepped`: prices cut to one decimal, whole-unit minimum quantity, levels that miss the
    minimum notional left out.
    """
    rows = mids
    afford = F.floor(F.col("max_orders") / 2) if "max_orders" in mids.columns else F.lit(levels)
    rows = rows.withColumn("_n", F.least(F.lit(levels), afford).cast("double"))
    if positions_df is not None:
        held = positions_df.select("symbol", F.col("quantity").alias("_pos"))
        rows = rows.join(held, "symbol", "left")
        skew = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.col("_pos"), F.lit(0.0)) / max_position))
        rows = rows.withColumn("skew", skew).drop("_pos")
    else:
        rows = rows.withColumn("skew", F.lit(0.0))
    fewer = F.round(F.col("_n") * ((F.lit(1.0) - F.abs("skew")) * 0.5 + 0.5))
    bids = F.when(F.col("skew") > 0, fewer).otherwise(F.col("_n")).cast("int")
    asks = F.when(F.col("skew") < 0, fewer).otherwise(F.col("_n")).cast("int")

    def side(name: str, sign: int, count: Column) -> Column:
        steps = F.filter(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: i <= count)
        return F.transform(steps, lambda i: F.struct(F.lit(name).alias("side"), i.alias("level"), (i * sign).alias("step")))

    rows = rows.withColumn("_q", F.explode(F.concat(side("buy", -1, bids), side("sell", 1, asks))))
    rows = rows.select(*[c for c in rows.columns if c not in ("_q", "_n")], "_q.*")
    if style == "stepped":
        def cut(value: Column, digits: int) -> Column:
            scaled = value * 10**digits
            return F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)) / 10**digits

        price = cut(cut(F.col("mid"), 1) + F.col("step") * spread, 1)
        quantity = cut(F.greatest(F.lit(order_size), F.ceil(min_notional / F.col("price")).cast("double")), 3)
        out = rows.withColumn("price", price).withColumn("quantity", quantity)
        out = out.filter(F.col("price") * F.col("quantity") >= min_notional)
    else:
        price = _tick(_tick(F.col("mid"), tick) + F.col("step") * spread, tick)
        quantity = F.ceil(F.greatest(F.lit(order_size), min_notional / F.col("price")) * 1000) / 1000
        out = rows.withColumn("price", price).withColumn("quantity", quantity)
    return out.drop("step")
