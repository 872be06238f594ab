"""Column builders for numbers, timestamps, symbols and log text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nanoseconds per unit of a timestamp.
NANOS = {"seconds": 1_000_000_000, "milliseconds": 1_000_000, "microseconds": 1_000, "nanoseconds": 1}

# Timestamp unit a venue is known to send.
VENUE_UNITS = {
    "Binance": "milliseconds", "Bybit": "milliseconds", "OKX": "milliseconds", "Coinbase": "milliseconds",
    "Upbit": "seconds", "Bithumb": "seconds", "Deribit": "microseconds",
}

# Range and tolerance for telling timestamps (ms) from sequence numbers.
MIN_TS_MS, MAX_TS_MS = 1_000_000_000_000, 2_000_000_000_000
TWO_YEARS_MS = 2 * 365 * 24 * 60 * 60 * 1000

# Quote assets recognised at the end (or start) of native symbols, in order.
QUOTE_SUFFIXES = {
    "Binance": ("USDT", "BUSD", "BTC", "ETH", "BNB"), "Bybit": ("USDT", "USDC", "BTC", "ETH"),
}
QUOTE_PREFIXES = {"Upbit": ("KRW", "USDT", "BTC")}


def whole_div(value: Column, by: Column) -> Column:
    """Integer division toward zero, exact over the whole LONG range."""
    return F.call_function("div", value, by)


def parse_scaled(text: Column, precision: int) -> Column:
    """Decimal text to an integer at `precision`: fraction padded or cut; NULL on bad text or overflow."""
    ok = text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")
    whole = F.regexp_extract(text, r"^([+-]?[0-9]*)", 1)
    fraction = F.regexp_extract(text, r"\.([0-9]*)$", 1)
    digits = F.concat(whole, F.rpad(F.substring(fraction, 1, precision), precision, "0")) if precision else whole
    return F.when(ok, digits.try_cast("bigint"))


def rescale_e8(scaled: Column, precision: Column) -> Column:
    """Integer at `precision` to 1e8 scale: multiply up or divide down toward zero."""
    up = F.pow(F.lit(10), F.lit(8) - precision).cast("long")
    down = F.pow(F.lit(10), precision - F.lit(8)).cast("long")
    lowered = whole_div(scaled, F.greatest(down, F.lit(1)))
    return F.when(precision < 8, scaled * up).when(precision > 8, lowered).otherwise(scaled)


def from_e8(scaled: Column) -> Column:
    return scaled / F.lit(100_000_000.0)


def unit_nanos(unit: Column) -> Column:
    out = None
    for name, factor in NANOS.items():
        out = F.when(unit == name, F.lit(factor)) if out is None else out.when(unit == name, F.lit(factor))
    return out.cast("long")


def digits_of(value: Column) -> Column:
    return F.length(F.abs(value).cast("string"))


def unit_of_digits(digits: Column) -> Column:
    return (
        F.when(digits <= 10, "seconds").when(digits <= 13, "milliseconds").when(digits <= 16, "microseconds")
        .when(digits <= 19, "nanoseconds").otherwise("milliseconds")
    )


def to_millis(value: Column, unit: Column) -> Column:
    def cut(by: int) -> Column:
        return whole_div(value, F.lit(by))

    return (
        F.when(unit == "seconds", value * 1000).when(unit == "milliseconds", value)
        .when(unit == "microseconds", cut(1000)).when(unit == "nanoseconds", cut(1_000_000))
    )


def is_timestamp(value: Column, reference_ms: Column) -> Column:
    """Whether a field holds a time rather than a sequence number."""
    n = digits_of(value)

    def plausible(ms: Column) -> Column:
        return ms.between(MIN_TS_MS, MAX_TS_MS)

    def near(ms: Column) -> Column:
        return plausible(ms) & (F.abs(ms - reference_ms) < TWO_YEARS_MS)

    return (
        F.when(n == 10, near(value * 1000)).when(n == 13, near(value))
        .when(n == 16, plausible(F.floor(value / 1000))).otherwise(F.lit(False))
    )


def common_symbol(exchange: Column, symbol: Column) -> Column:
    """Native to common spelling (BASE-QUOTE); unknown patterns and venues stay as they are."""
    out = symbol
    for venue, suffixes in QUOTE_SUFFIXES.items():
        text = symbol
        for quote in reversed(suffixes):
            text = F.when(symbol.endswith(quote), F.regexp_replace(symbol, f"{quote}$", f"-{quote}")).otherwise(text)
        out = F.when(F.lower(exchange) == venue.lower(), text).otherwise(out)
    for venue, prefixes in QUOTE_PREFIXES.items():
        text = symbol
        for quote in reversed(prefixes):
            swapped = F.concat(F.substring(symbol, len(quote) + 2, 10_000), F.lit(f"-{quote}"))
            text = F.when(symbol.startswith(f"{quote}-"), swapped).otherwise(text)
        out = F.when(F.lower(exchange) == venue.lower(), text).otherwise(out)
    return out


def escape_log(text: Column) -> Column:
    """Backslashes, quotes and line breaks escaped so that a row stays one line."""
    for plain, safe in (("\\", "\\\\"), ('"', '\\"'), ("\r", "\\r"), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def truncate_log(text: Column, max_len: int) -> Column:
    """Text cut to max_len characters with its full length noted."""
    note = F.concat(F.substring(text, 1, max_len), F.lit("... ("), F.length(text).cast("string"), F.lit(" chars)"))
    return F.when(F.length(text) <= max_len, text).otherwise(note)
