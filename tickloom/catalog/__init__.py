"""Registered queries: name -> (Spark callable, oracle SQL for DuckDB or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


_REGISTRY: dict[str, Query] = {}
_MODULES = ("flow", "venues", "book", "depth", "quality", "ingest", "scalars", "positions", "ops", "derivatives", "streams")


def query(name: str, oracle: str | None = None):
    """Register a builder `(spark, sf_dir) -> DataFrame` under a survey name."""

    def wrap(build):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, build, oracle)
        return build

    return wrap


def last_accepted(rows: str, price: str, order: str, limit: float) -> str:
    """SQL of the tables `numbered` and `judged`: rows of the table `rows`, one after another, against the last accepted price of their key.

    `early` is the first check that failed before, or NULL. The query has to begin with WITH RECURSIVE.
    """
    jump = f"abs((v.{price} - f.last) / f.last) * 100 > {limit}"
    return f""",
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY {order}) AS nth FROM {rows}),
judged AS (
  SELECT exchange, symbol, nth, CASE WHEN early IS NULL THEN {price} END AS last, false AS outlier FROM numbered WHERE nth = 1
  UNION ALL
  SELECT v.exchange, v.symbol, v.nth, CASE WHEN v.early IS NOT NULL OR v.{price} IS NULL OR {jump} THEN f.last ELSE v.{price} END,
         v.early IS NULL AND coalesce({jump}, false)
  FROM judged f JOIN numbered v ON v.exchange = f.exchange AND v.symbol = f.symbol AND v.nth = f.nth + 1)"""


def registry() -> dict[str, Query]:
    for module in _MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return _REGISTRY
