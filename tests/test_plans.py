"""Shape of physical plans: pruned scans, pushed filters, no nested-loop joins of two large sides."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tickloom.catalog import registry
from tickloom.operators import flow
from tickloom.sources.fixtures import view


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["features", "l3_events", "book_levels_actions", "propagated_inversions", "positions", "nbbo", "asof_book_lag"])
def test_no_nested_loops(spark, sf, name):
    text = plan(registry()[name].build(spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_needed_columns(spark, sf):
    text = plan(flow.rolling_vwap(view(spark, sf, "fx_trades"), 3_600_000_000).select("trade_id", "vwap"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "event_type" not in schema and "value" in schema


def test_filter_reaches_the_scan(spark, sf):
    text = plan(view(spark, sf, "lineitem").filter(F.col("l_quantity") > 49).select("l_orderkey"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(l_quantity", text)


@pytest.mark.parametrize("name", ["rolling_vwap", "l3_events", "inversion_stats", "trade_validation", "seq_gaps"])
def test_row_windows_carry_the_chunk(spark, sf, name):
    """Windows over rows are partitioned by key and chunk; those without a chunk run on summaries
    (their sort is by the chunk itself)."""
    text = plan(registry()[name].build(spark, sf))
    windows = re.findall(r"windowspecdefinition\(([^)]*?) (?:ASC|DESC)", text)
    assert windows and all("_chunk" in w for w in windows)


def test_trades_window_uses_one_row_shuffle(spark, sf):
    text = plan(flow.price_momentum(view(spark, sf, "fx_trades"), 3_600_000_000, 7_200_000_000))
    assert text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["nbbo", "trade_validation", "positions"])
def test_folds_deal_rows_by_key_and_chunk(spark, sf, name):
    """Rows are dealt by key and chunk before every pass over them; by key alone only the descriptions of chunks are."""
    text = plan(registry()[name].build(spark, sf))
    dealt = re.findall(r"MapInArrow _(\w+)\(|Exchange hashpartitioning\(([^)]*)\), REPARTITION_BY_COL", text)
    by_key_alone = [keys for _, keys in dealt if keys and "_chunk" not in keys]
    assert len(by_key_alone) <= 1 and sum("_chunk" in keys for _, keys in dealt) >= 2
