"""Stream quality: ordering, sequence gaps, latency and formats of received packets.

Input `packets`: stage, exchange, symbol, packet_type, exchange_ms, recv_ms, sequence,
size_bytes and a tie-breaker `event_id`. `arrivals` computes each packet's predecessor once;
the reports below are aggregations over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.ordered import (
    CHUNK, chunk_of, cumsum, following, order_statistics, prev, scan,
)
from tickloom.plans.sliding import rows as rows_in
from tickloom.plans.sliding import sliding

KEY = ["exchange", "symbol"]
DAY_MS = 86_400_000
ARRIVAL = ["recv_ms", "event_id"]


def arrivals(packets: DataFrame, keys: list[str] = KEY, chunk_ms: int = DAY_MS) -> DataFrame:
    """Packets in arrival order with the previous timestamp and sequence of their key."""
    seen = scan(
        packets, list(keys), ARRIVAL, chunk_of("recv_ms", chunk_ms), prev_ms=prev(F.col("exchange_ms")),
        prev_sequence=prev(F.col("sequence")),
    )
    last_ms, last_seq = F.col("prev_ms"), F.col("prev_sequence")
    inverted = F.coalesce(F.col("exchange_ms") < last_ms, F.lit(False))
    gap = F.coalesce(F.col("sequence") > last_seq + 1, F.lit(False))
    return seen.withColumns({
        "inverted": inverted,
        "inversion_ms": F.when(inverted, last_ms - F.col("exchange_ms")),
        "gap_size": F.when(gap, F.col("sequence") - last_seq - 1),
        "out_of_order": F.coalesce(F.col("sequence") <= last_seq, F.lit(False)),
        "latency_ms": F.col("recv_ms") - F.col("exchange_ms"),
    })


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _level() -> Column:
    return F.element_at(F.array(F.lit("symbol"), F.lit("exchange"), F.lit("-"), F.lit("all")), F.grouping_id().cast("int") + 1)


def latency_stats(packets: DataFrame) -> DataFrame:
    """Count, mean, sample deviation and extremes of receive latency, overall, per exchange and per symbol."""
    lat = F.col("recv_ms") - F.col("exchange_ms")
    return packets.withColumn("_l", lat).rollup("exchange", "symbol").agg(
        _level().alias("level"), F.count("_l").alias("packets"), F.avg("_l").alias("mean_ms"),
        F.stddev_samp("_l").alias("std_ms"), F.min("_l").alias("min_ms"), F.max("_l").alias("max_ms"),
    )


def latency_percentiles(
    packets: DataFrame, ps: tuple[int, ...] = (50, 95, 99), exact: bool = False, keys: tuple[str, ...] = ("exchange",),
    value_chunk_ms: int = 60_000, of: str = "n-1",
) -> DataFrame:
    """p50/p95/p99 of latency per key: exact at index floor((n-1)p/100), with `of="n"` at floor(n p/100), or sketched."""
    rows = packets.withColumn("latency_ms", F.col("recv_ms") - F.col("exchange_ms"))
    if not exact:
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.percentile_approx("latency_ms", p / 100, 10_000).alias(f"p{p}_ms") for p in ps],
        )
    size = {"n-1": F.col("n") - 1, "n": F.col("n")}[of]
    ranks = {f"p{p}_ms": F.least(F.floor(size * p / 100), F.col("n") - 1) for p in ps}
    return order_statistics(rows, list(keys), "latency_ms", ranks, chunk_of("latency_ms", value_chunk_ms))


def _inversion_aggs() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("packets"), _n(F.col("inverted")).alias("inversions"),
        (_n(F.col("inverted")) / F.count(F.lit(1)) * 100).alias("inversion_pct"),
        F.max("inversion_ms").alias("max_inversion_ms"), F.avg("inversion_ms").alias("mean_inversion_ms"),
        F.min("inversion_ms").alias("min_inversion_ms"),
    ]


def inversion_stats(packets: DataFrame) -> DataFrame:
    """Timestamp inversions per key with totals per exchange and overall."""
    return arrivals(packets).rollup("exchange", "symbol").agg(_level().alias("level"), *_inversion_aggs())


def sequence_gap_stats(packets: DataFrame) -> DataFrame:
    return arrivals(packets).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("packets"), F.count("gap_size").alias("gaps"), F.sum("gap_size").alias("missing"),
        F.max("gap_size").alias("max_gap"), _n(F.col("out_of_order")).alias("out_of_order"),
    )


def stream_health_score(packets: DataFrame) -> DataFrame:
    """100 - 10 per percent of inversions - 5 per percent of gaps, within 0..100, and a grade."""
    rates = arrivals(packets).groupBy("exchange").agg(
        (_n(F.col("inverted")) / F.count(F.lit(1)) * 100).alias("inversion_pct"),
        (F.count("gap_size") / F.count(F.lit(1)) * 100).alias("gap_pct"),
    )
    score = F.lit(100.0) - F.col("inversion_pct") * 10 - F.col("gap_pct") * 5
    grade = F.when(F.col("inversion_pct") < 0.1, "EXCELLENT").when(F.col("inversion_pct") < 1, "GOOD").otherwise("POOR")
    return rates.withColumns({"score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), "grade": grade})


def size_class(ms: Column) -> Column:
    return (
        F.when(ms < 10, "tiny").when(ms < 100, "small").when(ms < 1000, "medium")
        .when(ms > 1_000_000_000, "format_jump").otherwise("large")
    )


def inversion_buckets(packets: DataFrame) -> DataFrame:
    """Inversions by size class and exchange, with every subtotal."""
    hits = arrivals(packets).filter("inverted").withColumn("bucket", size_class(F.col("inversion_ms")))
    return hits.cube("exchange", "bucket").agg(
        F.grouping_id().cast("long").alias("gid"), F.count(F.lit(1)).alias("inversions"),
        F.max("inversion_ms").alias("max_inversion_ms"),
    )


def inversion_hours(packets: DataFrame) -> DataFrame:
    """Inversions by hour of day of their receive time."""
    hour = F.floor(F.col("recv_ms") / 3_600_000) % 24
    return arrivals(packets).filter("inverted").groupBy("exchange", hour.alias("hour")).agg(
        F.count(F.lit(1)).alias("inversions")
    )


DELAYS = ("<10", "<50", "<100", "<500", "<1000", ">=1000")


def inversion_latency_correlation(packets: DataFrame, high_ms: int = 1000) -> DataFrame:
    """Per symbol: inversions by delay bucket, and split at the high-latency mark."""
    lat = F.col("latency_ms")
    bucket = (
        F.when(lat < 10, DELAYS[0]).when(lat < 50, DELAYS[1]).when(lat < 100, DELAYS[2]).when(lat < 500, DELAYS[3])
        .when(lat < 1000, DELAYS[4]).otherwise(DELAYS[5])
    )
    seen = arrivals(packets).withColumn("bucket", bucket)
    hit = F.col("inverted")
    return seen.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("packets"), _n(hit).alias("inversions"),
        *[_n(hit & (F.col("bucket") == name)).alias(f"delay_{i}") for i, name in enumerate(DELAYS)],
        _n(hit & (lat > high_ms)).alias("high_latency_inversions"),
        _n(hit & (lat <= high_ms)).alias("low_latency_inversions"),
        (_n(hit) / F.count(F.lit(1)) * 100).alias("inversion_pct"),
    )


def inter_arrival_gaps(packets: DataFrame) -> DataFrame:
    """Forward gaps between consecutive source timestamps of a symbol, over the symbols of each exchange."""
    seen = arrivals(packets)
    ahead = F.when(F.col("exchange_ms") >= F.col("prev_ms"), F.col("exchange_ms") - F.col("prev_ms"))
    gaps = seen.withColumn("_g", ahead)
    return gaps.groupBy("exchange").agg(
        F.min("_g").alias("min_gap_ms"), F.avg("_g").alias("avg_gap_ms"), F.max("_g").alias("max_gap_ms"),
        F.countDistinct("symbol").alias("active_symbols"),
    )


def inversion_diagnosis(packets: DataFrame) -> DataFrame:
    """One-row verdict on what drives the inversions."""
    seen = arrivals(packets)
    hit = F.col("inverted")
    per = seen.groupBy("exchange").agg(
        F.count(F.lit(1)).alias("n"), _n(hit).alias("inv"), _n(hit & (F.col("latency_ms") >= 1000)).alias("slow"),
        _n(hit & (F.col("inversion_ms") < 10)).alias("tiny"),
    )
    total = per.agg(
        F.sum("n").alias("packets"), F.sum("inv").alias("inversions"), F.sum("slow").alias("slow_inversions"),
        F.sum("tiny").alias("tiny_inversions"), F.max("inv").alias("worst_inversions"),
    )
    inv = F.col("inversions")
    verdict = (
        F.when(inv == 0, "clean").when(F.col("worst_inversions") > inv * 0.8, "single_venue")
        .when(F.col("tiny_inversions") > inv * 0.7, "batching").when(F.col("slow_inversions") > inv * 0.7, "network")
        .when(F.col("slow_inversions") < inv * 0.3, "source").otherwise("mixed")
    )
    return total.withColumn("verdict", verdict)


def inversion_causes(packets: DataFrame, chunk_ms: int = DAY_MS) -> DataFrame:
    """One-row verdict by the size and the succession of inversions.

    Inversions of all keys follow one another in arrival order. One of the same key as the one before is consecutive; one of another
    key is isolated unless it breaks off a row of consecutive ones, which ends as well with the key's next packet in order.
    First that holds: over 7 in 10 under 10 ms `network`; over 1 in 3 of a second and more `timestamps`; more consecutive than isolated
    `buffering`; one venue alone `single_venue`; else `mixed`.
    """
    at = F.struct(*ARRIVAL)
    seen = arrivals(packets, chunk_ms=chunk_ms)
    later = scan(seen, KEY, ARRIVAL, chunk_of("recv_ms", chunk_ms), _next=following(F.struct(at.alias("at"), F.col("inverted").alias("inverted"))))
    ends = F.when(~F.col("_next.inverted"), F.col("_next.at"))
    hits = later.filter("inverted").select(*ARRIVAL, "inversion_ms", "exchange", F.struct(*KEY).alias("k"), ends.alias("ends"))
    one = scan(hits, [], ARRIVAL, chunk_of("recv_ms", chunk_ms), keep_chunk=True, _k=prev(F.col("k")))
    one = one.withColumn("consecutive", F.coalesce(F.col("k") == F.col("_k"), F.lit(False)))
    two = scan(one, [], ARRIVAL, F.col(CHUNK), _p=prev(F.struct("consecutive", "ends")))
    running = F.coalesce(F.col("_p.consecutive") & ~F.coalesce(F.col("_p.ends") < at, F.lit(False)), F.lit(False))
    out = two.agg(
        F.count(F.lit(1)).alias("inversions"), _n(F.col("inversion_ms") < 10).alias("tiny_inversions"), _n(F.col("inversion_ms") >= 1000).alias("large_inversions"),
        _n(F.col("consecutive")).alias("consecutive"), _n(~F.col("consecutive") & ~running).alias("isolated"), F.countDistinct("exchange").alias("venues"),
    )
    n = F.col("inversions")
    verdict = (
        F.when(n == 0, "clean").when(F.col("tiny_inversions") > F.floor(n * 7 / 10), "network").when(F.col("large_inversions") > F.floor(n / 3), "timestamps")
        .when(F.col("consecutive") > F.col("isolated"), "buffering").when(F.col("venues") == 1, "single_venue").otherwise("mixed")
    )
    return out.withColumn("verdict", verdict)


def packet_integrity(packets: DataFrame) -> DataFrame:
    """Oversized (>1400 B), fragmented (>1500 B), clock-implausible (>1 year off) and unparsable packets."""
    off = F.abs(F.col("recv_ms") - F.col("exchange_ms")) > 365 * DAY_MS
    unread = ~F.col("parse_ok")
    return packets.groupBy("exchange").agg(
        F.count(F.lit(1)).alias("packets"), _n(F.col("size_bytes") > 1400).alias("oversized"),
        _n(F.col("size_bytes") > 1500).alias("fragmented"), _n(off).alias("clock_implausible"),
        _n(unread).alias("parse_errors"), _n(unread | (F.col("size_bytes") <= 0)).alias("corrupt"),
    )


def _format(digits: Column) -> Column:
    return (
        F.when(digits <= 10, "seconds").when(digits <= 13, "milliseconds").when(digits <= 16, "microseconds")
        .when(digits <= 19, "nanoseconds").otherwise("milliseconds")
    )


def timestamp_format_report(packets: DataFrame, samples: int = 3, chunk_ms: int = DAY_MS) -> DataFrame:
    """Dominant digit count and format of `raw_ts` per exchange, switches between formats and last samples."""
    rows = packets.withColumn("digits", F.length(F.abs("raw_ts").cast("string")))
    linked = scan(rows, ["exchange"], ARRIVAL, chunk_of("recv_ms", chunk_ms), _d=prev(F.col("digits")))
    counts = linked.groupBy("exchange", "digits").agg(
        F.count(F.lit(1)).alias("_n"), _n(F.col("_d").isNotNull() & (F.col("_d") != F.col("digits"))).alias("_s")
    )
    per = counts.groupBy("exchange").agg(
        F.max_by("digits", F.struct("_n", "digits")).alias("digits"), F.sum("_n").alias("packets"),
        F.sum("_s").alias("format_switches"),
    ).withColumn("format", _format(F.col("digits")))
    # the rank filter is applied per map task before the shuffle, so no exchange is sorted whole
    newest = Window.partitionBy("exchange").orderBy(F.col("recv_ms").desc(), F.col("event_id").desc())
    last = rows.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= samples)
    text = last.groupBy("exchange").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "raw_ts"))), lambda x: x["raw_ts"].cast("string")), ",").alias("last_samples")
    )
    return per.join(text, "exchange")


def burst_inversions(packets: DataFrame, window_ms: int = 1000, min_count: int = 3) -> DataFrame:
    """Each inversion as burst (more than min_count of the key inside the window) or isolated."""
    hits = arrivals(packets).filter("inverted")
    out = sliding(hits, KEY, "recv_ms", window_ms - 1, 4 * window_ms, recent=rows_in())
    return out.withColumn("kind", F.when(F.col("recent") > min_count, "burst").otherwise("isolated"))


def consecutive_inversions(packets: DataFrame, chunk_ms: int = DAY_MS) -> DataFrame:
    """Lengths of unbroken inversion runs per key: number of runs, longest, isolated ones."""
    seen = arrivals(packets, chunk_ms=chunk_ms)
    marked = scan(seen, KEY, ARRIVAL, chunk_of("recv_ms", chunk_ms), _run=cumsum((~F.col("inverted")).cast("long")))
    runs = marked.filter("inverted").groupBy(*KEY, "_run").agg(F.count(F.lit(1)).alias("_len"))
    return runs.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("runs"), F.max("_len").alias("longest_run"), _n(F.col("_len") == 1).alias("isolated"),
        F.sum("_len").alias("inversions"),
    )


def per_minute_series(packets: DataFrame, width_ms: int = 60_000) -> DataFrame:
    start = (F.floor(F.col("recv_ms") / width_ms) * width_ms).alias("window_ms")
    return arrivals(packets).groupBy("exchange", start).agg(
        F.count(F.lit(1)).alias("packets"), _n(F.col("inverted")).alias("inversions")
    )


def _per_key(packets: DataFrame) -> DataFrame:
    return arrivals(packets).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("packets"), _n(F.col("inverted")).alias("inversions")
    )


def topk_problem_symbols(packets: DataFrame, k: int = 3) -> DataFrame:
    ranked = Window.partitionBy("exchange").orderBy(F.col("inversions").desc(), "symbol")
    return _per_key(packets).withColumn("rank", F.row_number().over(ranked).cast("long")).filter(F.col("rank") <= k)


def worst_exchange(packets: DataFrame) -> DataFrame:
    per = arrivals(packets).groupBy("exchange").agg(_n(F.col("inverted")).alias("inversions"))
    return per.agg(
        F.max_by("exchange", F.struct("inversions", "exchange")).alias("exchange"), F.max("inversions").alias("inversions")
    )


def active_symbols_topk(packets: DataFrame, k: int = 10) -> DataFrame:
    """The k busiest keys with inversions and rate; `remaining` keys are not shown."""
    per = _per_key(packets).withColumn("inversion_pct", F.col("inversions") / F.col("packets") * 100)
    remaining = packets.select(*KEY).distinct().agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0))).scalar()
    return per.orderBy(F.col("packets").desc(), "exchange", "symbol").limit(k).withColumn("remaining", remaining)


def pre_post_compare(packets: DataFrame) -> DataFrame:
    """Inversions before sending and after receiving per key, and those added in transit."""
    staged = arrivals(packets, ["stage", *KEY]).groupBy(*KEY).agg(*[
        agg for stage, name in (("pre_send", "pre"), ("post_receive", "post")) for agg in (
            _n(F.col("stage") == stage).alias(f"{name}_packets"),
            _n((F.col("stage") == stage) & F.col("inverted")).alias(f"{name}_inversions"),
        )
    ])
    return staged.withColumns({
        "added_inversions": F.col("post_inversions") - F.col("pre_inversions"),
        "lost_packets": F.col("pre_packets") - F.col("post_packets"),
    })


def propagated_inversions(sent: DataFrame, received: DataFrame) -> DataFrame:
    """Each received inversion as propagated (the same consecutive pair was sent) or network."""
    pairs = arrivals(sent).filter("inverted").select(*KEY, "prev_ms", "exchange_ms").distinct().withColumn(
        "_hit", F.lit(True)
    )
    hits = arrivals(received).filter("inverted")
    out = hits.join(pairs, [*KEY, "prev_ms", "exchange_ms"], "left")
    return out.withColumn("origin", F.when(F.col("_hit"), "propagated").otherwise("network")).drop("_hit")


def partition_balance(packets: DataFrame, shards: int = 4) -> DataFrame:
    """Load per shard of the key hash; balanced when no shard is off the mean by more than half."""
    name = F.concat_ws(":", "exchange", "symbol")
    shard = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % shards
    per = packets.groupBy(shard.alias("shard")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("size_bytes").alias("bytes"), F.countDistinct("exchange", "symbol").alias("keys")
    )
    mean = F.sum("packets").over(Window.partitionBy()) / shards  # one row per shard
    off = F.abs(F.col("packets") - F.col("mean_packets")) / F.col("mean_packets") * 100
    return per.withColumn("mean_packets", mean).withColumn("deviation_pct", off).withColumn(
        "balanced", F.max("deviation_pct").over(Window.partitionBy()) <= 50
    )


def packet_mix(packets: DataFrame) -> DataFrame:
    """Packets by type for each exchange and asset class of an `exchange_asset` name, last seen."""
    parts = F.split("source", "_")
    return packets.withColumns({"venue": parts[0], "asset": F.coalesce(F.get(parts, 1), F.lit("spot"))}).groupBy(
        "venue", "asset"
    ).agg(
        F.count(F.lit(1)).alias("packets"), _n(F.col("packet_type") == "TRADE").alias("trades"),
        _n(F.col("packet_type") == "ORDERBOOK").alias("orderbooks"),
        _n(~F.col("packet_type").isin("TRADE", "ORDERBOOK")).alias("text"), F.max("recv_ms").alias("last_seen_ms"),
    )


def reorder_by_event_time(packets: DataFrame, window_ms: int) -> DataFrame:
    """Packets of each flush window in source-time order: position, and whether it moved."""
    flush = F.floor(F.col("recv_ms") / window_ms)
    rows = packets.withColumn("flush", flush)
    lane = Window.partitionBy(*KEY, "flush")
    return rows.withColumns({
        "arrival_pos": F.row_number().over(lane.orderBy("recv_ms", "event_id")).cast("long"),
        "emit_pos": F.row_number().over(lane.orderBy("exchange_ms", "event_id")).cast("long"),
    }).withColumn("reordered", F.col("arrival_pos") != F.col("emit_pos"))


def merge_venue_streams(*streams: DataFrame) -> DataFrame:
    """One stream of many venues; columns a venue lacks are NULL."""
    out = streams[0]
    for other in streams[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
