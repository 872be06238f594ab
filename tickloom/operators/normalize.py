"""Scaling, timestamps, symbol mapping and routing of normalised rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import scalars as s
from tickloom.plans.ordered import cumsum, scan


def scale_by_precision(df: DataFrame, dim_precision: DataFrame) -> DataFrame:
    """Price and quantity as integer ticks. Decimals come from (exchange, symbol), else from the
    exchange's default for the quote asset, else from the symbol alone, else 8.

    `dim_precision`: exchange NULL for symbol-only rows; symbol NULL and quote set for defaults.
    """
    exact = dim_precision.filter("exchange IS NOT NULL AND symbol IS NOT NULL").select(
        "exchange", "symbol", F.col("price_decimals").alias("_p1"), F.col("quantity_decimals").alias("_q1"))
    by_quote = dim_precision.filter("exchange IS NOT NULL AND symbol IS NULL").select(
        "exchange", "quote", F.col("price_decimals").alias("_p2"))
    alone = dim_precision.filter("exchange IS NULL").select(
        "symbol", F.col("price_decimals").alias("_p3"), F.col("quantity_decimals").alias("_q3"))
    out = df.withColumn("quote", F.get(F.split("symbol", "/"), 1))
    out = out.join(exact, ["exchange", "symbol"], "left").join(by_quote, ["exchange", "quote"], "left")
    out = out.join(alone, "symbol", "left")
    price_dec = F.coalesce("_p1", "_p2", "_p3", F.lit(8))
    qty_dec = F.coalesce("_q1", F.when(F.col("_p2").isNotNull(), F.lit(8)), "_q3", F.lit(8))
    ten = F.lit(10.0)
    return out.withColumns({
        "price_decimals": price_dec, "quantity_decimals": qty_dec,
        "price_scaled": F.round(F.col("price") * F.pow(ten, price_dec)).cast("long"),
        "quantity_scaled": F.round(F.col("quantity") * F.pow(ten, qty_dec)).cast("long"),
    }).drop("_p1", "_q1", "_p2", "_p3", "_q3", "quote")


def price_to_ticks(df: DataFrame, dim_tick: DataFrame) -> DataFrame:
    """Price as ticks of its instrument and back, quantity at 1e8; instruments without tick are dropped."""
    out = df.join(dim_tick, ["exchange", "symbol"])
    ticks = F.floor(F.round(F.col("price") / F.col("tick_size"), 9)).cast("long")
    return out.withColumn("price_ticks", ticks).withColumns({
        "tick_price": F.col("price_ticks") * F.col("tick_size"),
        "quantity_e8": F.round(F.col("quantity") * 100_000_000).cast("long"),
    })


def ts_to_nanos(df: DataFrame, unit_col: str = "timestamp_unit") -> DataFrame:
    """Unit-aware timestamp to nanoseconds; an overflow leaves NULL and is flagged for quarantine."""
    nanos = F.try_multiply(F.col("timestamp"), s.unit_nanos(F.col(unit_col)))
    return df.withColumn("ts_ns", nanos).withColumn("overflow", F.col("ts_ns").isNull())


def nanos_to_unit(df: DataFrame, unit_col: str = "timestamp_unit") -> DataFrame:
    return df.withColumn("timestamp", s.whole_div(F.col("ts_ns"), s.unit_nanos(F.col(unit_col))))


def normalize_ts(df: DataFrame, dim_format: DataFrame | None = None) -> DataFrame:
    """Timestamp to milliseconds by the venue's known unit (its name in any case), else by its number of digits."""
    guess = s.unit_of_digits(s.digits_of(F.col("timestamp")))
    if dim_format is not None:
        df = df.join(dim_format.select("exchange", F.col("unit").alias("_unit")), "exchange", "left")
        known = F.col("_unit")
    else:
        known = F.create_map(*[F.lit(x) for venue, unit in s.VENUE_UNITS.items() for x in (venue.lower(), unit)])[F.lower("exchange")]
    unit = F.coalesce(known, guess)
    return df.withColumn("ts_ms", s.to_millis(F.col("timestamp"), unit)).drop("_unit")


def classify_ts(df: DataFrame, ref_time: Column) -> DataFrame:
    value = F.col("timestamp")
    ms = s.to_millis(value, s.unit_of_digits(s.digits_of(value)))
    return df.withColumn("is_timestamp", s.is_timestamp(value, ref_time)).withColumn(
        "ts_ms", F.when(F.col("is_timestamp"), ms).otherwise(value)
    )


def repair_ts(df: DataFrame, recv_ms: str = "recv_ms") -> DataFrame:
    """Sequence numbers in a timestamp field give way to the receive time."""
    judged = classify_ts(df, F.col(recv_ms))
    return judged.withColumn("ts_ms", F.when(F.col("is_timestamp"), F.col("ts_ms")).otherwise(F.col(recv_ms)))


def common_symbol(df: DataFrame) -> DataFrame:
    return df.withColumn("common_symbol", s.common_symbol(F.col("exchange"), F.col("native_symbol")))


def map_symbol(df: DataFrame, dim_symbol: DataFrame, on_missing: str = "drop") -> DataFrame:
    """Common symbol from the mapping; rows without one are dropped or keep their native symbol."""
    dim = dim_symbol.select("exchange", "native_symbol", F.col("common_symbol").alias("_common"))
    out = df.join(dim, ["exchange", "native_symbol"], "inner" if on_missing == "drop" else "left")
    return out.withColumn("symbol", F.coalesce("_common", "native_symbol")).drop("_common")


def unmapped_symbols(messages: DataFrame, dim_symbol: DataFrame) -> DataFrame:
    """Native symbols seen in the feed and absent from the mapping, with their message counts."""
    seen = messages.groupBy("exchange", "native_symbol").agg(F.count(F.lit(1)).alias("messages"))
    return seen.join(dim_symbol.select("exchange", "native_symbol"), ["exchange", "native_symbol"], "left_anti")


def distinct_symbols(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out.distinct()


def _ids(names: DataFrame, column: str, name: str) -> DataFrame:
    numbered = scan(names, [], [column], F.substring(column, 1, 2), _n=cumsum(F.lit(1)))
    return numbered.withColumn(name, (F.col("_n") - 1).cast("long")).drop("_n")


def symbol_ids(df: DataFrame) -> DataFrame:
    """Dense ids of lower-cased exchanges and upper-cased symbols, joined back to the rows."""
    keyed = df.withColumns({"_e": F.lower("exchange"), "_s": F.upper("symbol")})
    exchanges = _ids(keyed.select("_e").distinct(), "_e", "exchange_id")
    symbols = _ids(keyed.select("_s").distinct(), "_s", "symbol_id")
    return keyed.join(exchanges, "_e").join(symbols, "_s").drop("_e", "_s")


def route_market_data(df: DataFrame, config: dict) -> DataFrame:
    """Rows a flow accepts, tagged with the flow: `crypto` and `stock` each have their filters.

    Long symbol lists can be passed as DataFrames (`symbols_df`) and become semi joins.
    """
    def flow(name: str, base: DataFrame, rules: dict) -> DataFrame:
        rows = base
        if rules.get("symbols_df") is not None:
            rows = rows.join(rules["symbols_df"].select("symbol").distinct(), "symbol", "left_semi")
        elif rules.get("symbols") and not rules.get("enable_all_symbols", False):
            rows = rows.filter(F.col("symbol").isin(*rules["symbols"]))
        if rules.get("exchanges"):
            rows = rows.filter(F.col("exchange").isin(*rules["exchanges"]))
        if name == "stock":
            if not rules.get("enable_derivatives", True):
                rows = rows.filter(~F.col("asset_type").isin("futures", "options"))
            if not rules.get("enable_etf", True):
                rows = rows.filter(F.col("asset_type") != "etf")
            if rules.get("asset_types"):
                rows = rows.filter(F.col("asset_type").isin(*rules["asset_types"]))
        return rows.withColumn("flow", F.lit(name))

    crypto = flow("crypto", df.filter(F.col("flow_in") == "crypto"), config.get("crypto", {}))
    stock = flow("stock", df.filter(F.col("flow_in") == "stock"), config.get("stock", {}))
    return crypto.unionByName(stock).drop("flow_in")


def routing_counts(routed: DataFrame) -> DataFrame:
    """Rows routed per flow and data type, with every subtotal."""
    return routed.cube("flow", "data_type").agg(
        F.grouping_id().cast("long").alias("gid"), F.count(F.lit(1)).alias("rows")
    )


def safe_log_fields(df: DataFrame, max_len: int = 800, columns: tuple[str, ...] = ("message",)) -> DataFrame:
    return df.withColumns({c: s.escape_log(s.truncate_log(F.col(c), max_len)) for c in columns})
