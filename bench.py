"""Time the headline queries and print one JSON line.

$BENCH_SF_DIR (default /root/testdata/sf0.1), local[$BENCH_CPUS] (default 8). Each query is
written to the noop sink, so every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from tickloom.catalog import registry
from tickloom.session import build_session

HEADLINE = (
    "rolling_vwap", "trade_flow_notional", "tick_flow_updown", "large_trade_imbalance", "nbbo", "nbbo_statistics",
    "cross_exchange_pairs", "seq_gaps", "l3_events", "book_levels_at", "top_of_book", "wap_depth", "book_checksum",
    "asof_book_lag", "features", "signals", "inversion_stats", "latency_percentiles", "propagated_inversions",
    "consecutive_inversions", "normalize_binance", "normalize_coinbase", "positions", "risk_audit", "ops_hourly",
    "options_chain_summary", "momentum_signal", "stream_features_tumbling",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "tickloom-bench", int(cpus))
    queries = registry()
    queries["market_totals"].build(spark, folder).write.format("noop").mode("overwrite").save()  # warm up
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        queries[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
