"""Small column builders shared by the operators; undefined ratios are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator)


def imbalance(buys: Column, sells: Column) -> Column:
    """(buys - sells) / (buys + sells), NULL when both are empty."""
    total = buys + sells
    return F.when(total > 0, (buys - sells) / total)


def signed(side: Column, amount: Column) -> Column:
    return F.when(side == "buy", amount).otherwise(-amount)


def where(condition: Column, amount: Column) -> Column:
    """`amount` where the condition holds, else 0.0; for conditional sums."""
    return F.when(condition, amount).otherwise(F.lit(0.0))
