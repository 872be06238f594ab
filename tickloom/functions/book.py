"""Column builders over a book row: `bids` (best first) and `asks` (best first), arrays of
struct<price, quantity>. All stay in the JVM as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.ratios import imbalance


def best(side: str, field: str) -> Column:
    return F.get(F.col(side), 0)[field]


def mid() -> Column:
    return (best("bids", "price") + best("asks", "price")) / 2


def total(levels: Column, value) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda acc, lv: acc + value(lv))


def qty(lv: Column) -> Column:
    return lv["quantity"]


def notional(lv: Column) -> Column:
    return lv["price"] * lv["quantity"]


def within(side: str, depth_bps: float) -> Column:
    """Levels no further from the mid than depth_bps of it."""
    centre = mid()
    limit = centre * F.lit(float(depth_bps)) / 10_000
    if side == "bids":
        return F.filter("bids", lambda lv: centre - lv["price"] <= limit)
    return F.filter("asks", lambda lv: lv["price"] - centre <= limit)


def top(side: str, n: int) -> Column:
    return F.slice(F.col(side), 1, n)


def both_sides() -> Column:
    return (F.size("bids") > 0) & (F.size("asks") > 0)


def queue_imbalance_top(n: int = 5) -> Column:
    return imbalance(total(top("bids", n), qty), total(top("asks", n), qty))


def volume_weighted_imbalance(levels: int) -> Column:
    def weighted(side: str) -> Column:
        shares = F.transform(top(side, levels), lambda lv, i: lv["quantity"] * (F.lit(1.0) / (i + F.lit(1.0))))
        return F.aggregate(shares, F.lit(0.0), lambda acc, x: acc + x)

    return imbalance(weighted("bids"), weighted("asks"))


def pressure_imbalance(depth: int = 10) -> Column:
    centre = mid()

    def pressure(side: str) -> Column:
        def push(lv: Column) -> Column:
            away = F.abs(lv["price"] - centre)
            return F.when(away > 0, lv["quantity"] / away).otherwise(F.lit(0.0))

        return total(top(side, depth), push)

    return F.when(both_sides(), imbalance(pressure("bids"), pressure("asks")))


def plain_number(value: Column) -> Column:
    """Up to eight decimals without trailing zeros, as checksums spell numbers."""
    text = value.cast("decimal(28,8)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def _spelled(lv: Column) -> Column:
    return F.concat(plain_number(lv["price"]), F.lit(":"), plain_number(lv["quantity"]))


def checksum_crc32(depth: int = 25) -> Column:
    """CRC32 (8 hex digits) of the interleaved top levels `p:q:p:q`."""
    rows = F.greatest(F.size(top("bids", depth)), F.size(top("asks", depth)))

    def pair(i: Column) -> Column:
        return F.array_compact(F.array(
            F.when(i < F.size(top("bids", depth)), _spelled(F.get(F.col("bids"), i))),
            F.when(i < F.size(top("asks", depth)), _spelled(F.get(F.col("asks"), i))),
        ))

    index = F.when(rows > 0, F.sequence(F.lit(0), rows - 1)).otherwise(F.array().cast("array<int>"))
    text = F.array_join(F.flatten(F.transform(index, pair)), ":")
    return F.lpad(F.lower(F.hex(F.crc32(text))), 8, "0")


def checksum_md5() -> Column:
    """MD5 over every level: bids as `p:q|`, then `||`, then asks."""
    def side(name: str) -> Column:
        return F.array_join(F.transform(F.col(name), lambda lv: F.concat(_spelled(lv), F.lit("|"))), "")

    return F.md5(F.concat(side("bids"), F.lit("||"), side("asks")))
