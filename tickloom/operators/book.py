"""Order books from snapshots and deltas.

Input is `l2_levels`: exchange, symbol, seq, ts_us, is_snapshot, side, price_ticks, price,
quantity; one row per price level touched by message `seq`. A price level is a slowly
changing fact: `level_intervals` gives each of its states a half-open [seq_from, seq_to),
closed by the next update of the level or by the next snapshot. Books at some points are
then interval joins, linear in updates plus output; books after every message are replayed
(`operators.replay`). Keys are split by chunks of `seq` everywhere, so neither a hot symbol
nor a long stretch without snapshot ends in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import book as bk
from tickloom.functions.ratios import imbalance
from tickloom.operators.accepted import LastAccepted
from tickloom.operators.ladders import truncated
from tickloom.operators.replay import replayed
from tickloom.plans.ordered import (
    CHUNK, Run, chunk_of, cummax, cumsum, ffill, following, interval_join, prev, scan,
)
from tickloom.plans.sliding import sliding, total
from tickloom.plans.streamfold import streamed_fold
from tickloom.session import ship_by_value

ship_by_value(__name__)

KEY = ["exchange", "symbol"]
LEVEL = [*KEY, "side", "price_ticks"]


def explode_levels(updates: DataFrame, tick: float = 0.01) -> DataFrame:
    """Rows of levels from update messages; the last entry of a price inside one message wins."""
    def rows(side: str) -> DataFrame:
        return updates.select(
            *KEY, "seq", "ts_us", "update_id", "is_snapshot", F.lit(side[:-1]).alias("side"),
            F.posexplode(side).alias("pos", "lv"),
        )

    flat = rows("bids").unionByName(rows("asks")).withColumn(
        "price_ticks", F.round(F.col("lv.price") / tick).cast("long")
    )
    return flat.groupBy(*KEY, "seq", "ts_us", "update_id", "is_snapshot", "side", "price_ticks").agg(
        F.max_by(F.col("lv.price"), "pos").alias("price"), F.max_by(F.col("lv.quantity"), "pos").alias("quantity")
    )


def messages(levels: DataFrame) -> DataFrame:
    return levels.groupBy(*KEY, "seq").agg(
        F.max("ts_us").alias("ts_us"), F.max("update_id").alias("update_id"), F.max("is_snapshot").alias("is_snapshot")
    )


def with_epoch(levels: DataFrame, chunk: int, last: bool = False) -> DataFrame:
    """Add `epoch` (seq of the snapshot in force), `next_epoch` / `next_epoch_ts` (the snapshot that
    ends it) and drop deltas before any snapshot. `last` adds the newest seq and time of the key."""
    snap = F.col("is_snapshot")
    runs = {
        "epoch": cummax(F.when(snap, F.col("seq")), "range"),
        "next_epoch": Run("last", F.when(snap, F.col("seq")), "range_before", reverse=True),
        "next_epoch_ts": Run("last", F.when(snap, F.col("ts_us")), "range_before", reverse=True),
    }
    if last:
        runs |= _newest()
    out = scan(levels, KEY, ["seq"], chunk_of("seq", chunk), **runs)
    return out.filter(F.col("epoch").isNotNull())


def _newest() -> dict[str, Run]:
    return {f"last_{c}": Run("max", F.col(c), "range", reverse=True) for c in ("seq", "ts_us")}


def level_intervals(levels: DataFrame, chunk: int, snapshots: bool = True) -> DataFrame:
    """Each state of a price level with seq_from/ts_from (inclusive) and seq_to/ts_to (exclusive).

    An open state ends one past the last row of the key. Deletes only close and are dropped.
    With `snapshots=False` (action-based venues) nothing is reset.
    """
    if snapshots:
        rows = with_epoch(levels, chunk, last=True)
    else:
        none = F.lit(None).cast("long")
        rows = scan(levels, KEY, ["seq"], chunk_of("seq", chunk), **_newest()).withColumns(
            {"epoch": F.lit(0).cast("long"), "next_epoch": none, "next_epoch_ts": none})
    linked = scan(
        rows, LEVEL, ["seq"], chunk_of("seq", chunk), next_seq=following(F.col("seq")), next_ts=following(F.col("ts_us")))
    reset = F.col("next_epoch").isNotNull() & (F.col("next_seq").isNull() | (F.col("next_epoch") <= F.col("next_seq")))
    return linked.filter(F.col("quantity") > 0).select(
        *LEVEL, "price", "quantity", "epoch", F.col("seq").alias("seq_from"),
        F.coalesce(F.least("next_seq", "next_epoch"), F.col("last_seq") + 1).alias("seq_to"), F.col("ts_us").alias("ts_from"),
        F.coalesce(F.when(reset, F.col("next_epoch_ts")).otherwise(F.col("next_ts")), F.col("last_ts_us") + 1).alias("ts_to"),
        reset.alias("closed_by_snapshot"),
    )


def book_levels_at(
    levels: DataFrame, points: DataFrame, chunk: int, axis: str = "seq", bucket: int | None = None,
    snapshots: bool = True,
) -> DataFrame:
    """Level rows in force at each point: `points` holds exchange, symbol and `at` on the axis.

    A point after the last row of its key sees the book as that row left it.
    """
    states = level_intervals(levels, chunk, snapshots).select(
        *LEVEL, "price", "quantity", F.col(f"{'seq' if axis == 'seq' else 'ts'}_from").alias("_from"),
        F.col(f"{'seq' if axis == 'seq' else 'ts'}_to").alias("_to"),
    )
    newest = levels.groupBy(*KEY).agg(F.max("seq" if axis == "seq" else "ts_us").alias("_newest"))
    seen = points.join(newest, KEY).withColumn("_at", F.least("at", "_newest"))
    found = interval_join(seen, states, KEY, "_at", "_from", "_to", bucket or chunk)
    return found.select(*points.columns, "side", "price_ticks", "price", "quantity")


def book_levels_actions(levels: DataFrame, points: DataFrame, chunk: int, axis: str = "seq", bucket: int | None = None):
    """Books of venues that send new / change / delete actions and no snapshots."""
    plain = levels.withColumn("quantity", F.when(F.col("action") == "delete", F.lit(0.0)).otherwise(F.col("quantity")))
    return book_levels_at(plain, points, chunk, axis, bucket, snapshots=False)


def _sides() -> list[Column]:
    level = F.struct("price", "quantity")
    return [
        F.sort_array(F.collect_list(F.when(F.col("side") == "bid", level)), asc=False).alias("bids"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "ask", level))).alias("asks"),
    ]


def books(levels: DataFrame, chunk: int, points: DataFrame | None = None, bucket: int | None = None) -> DataFrame:
    """Full book after each message (default) or after each message in `points` (exchange, symbol, seq, ts_us).

    Every message is answered by replay; the arrays are as long as the book is deep, so ask `replay.replayed` for measures
    where these are enough. Points join the intervals of the levels instead. A message that empties the book has empty arrays.
    Before the first snapshot of a key there is no book.
    """
    if points is None:
        return replayed(levels, chunk, depth=None).select(*KEY, "seq", "ts_us", "bids", "asks")
    width = bucket or max(1, chunk // 5)
    states = level_intervals(levels, chunk).select(*LEVEL, "price", "quantity", "seq_from", "seq_to")
    begun = levels.filter("is_snapshot").groupBy(*KEY).agg(F.min("seq").alias("_begun"))
    at = points.join(begun, KEY).filter(F.col("seq") >= F.col("_begun")).drop("_begun")
    found = interval_join(at, states, KEY, "seq", "seq_from", "seq_to", width, "left")
    return found.groupBy(*KEY, "_bucket", "seq", "ts_us").agg(*_sides()).drop("_bucket")


def numbered(rows: DataFrame, order: list[str], chunk: Column, name: str = "nth") -> DataFrame:
    return scan(rows, KEY, order, chunk, **{name: cumsum(F.lit(1))})


def book_snapshots_series(levels: DataFrame, chunk: int, every: int = 100) -> DataFrame:
    """The book at every `every`-th update of its key."""
    nth = numbered(messages(levels).select(*KEY, "seq", "ts_us"), ["seq"], chunk_of("seq", chunk))
    return books(levels, chunk, nth.filter(F.col("nth") % every == 0).drop("nth"))


def book_snapshots(levels: DataFrame, chunk: int, every: int = 1000, keep: int = 10) -> DataFrame:
    """Persistable snapshots: every N-th update, the newest `keep` per key."""
    total = messages(levels).groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    nth = numbered(messages(levels).select(*KEY, "seq", "ts_us"), ["seq"], chunk_of("seq", chunk))
    marks = nth.filter(F.col("nth") % every == 0).join(total, KEY)
    newest = F.floor(F.col("_n") / every) - F.col("nth") / every < keep
    kept = marks.filter(newest).select(*KEY, "seq", "ts_us", "nth")
    out = books(levels, chunk, kept.drop("nth"))
    return out.join(kept.select(*KEY, "seq", "nth"), [*KEY, "seq"])


def restore_from_snapshots(snapshots: DataFrame, levels: DataFrame) -> DataFrame:
    """Latest snapshot of each key plus the level updates that follow it, to be replayed; an empty book is one row without a level."""
    last = snapshots.groupBy(*KEY).agg(
        F.max("seq").alias("snapshot_seq"), F.max_by(F.struct("bids", "asks"), "seq").alias("book")
    )
    tail = levels.join(last.select(*KEY, "snapshot_seq"), KEY).filter(F.col("seq") > F.col("snapshot_seq"))
    base = last.select(*KEY, "snapshot_seq", F.explode_outer(F.concat(
        F.transform("book.bids", lambda lv: F.struct(F.lit("bid").alias("side"), lv["price"].alias("price"), lv["quantity"].alias("quantity"))),
        F.transform("book.asks", lambda lv: F.struct(F.lit("ask").alias("side"), lv["price"].alias("price"), lv["quantity"].alias("quantity"))),
    )).alias("lv")).select(*KEY, F.col("snapshot_seq").alias("seq"), F.lit(True).alias("is_snapshot"), "lv.*")
    return base.unionByName(tail.select(*KEY, "seq", "is_snapshot", "side", "price", "quantity"))


def restored_books(snapshots: DataFrame, levels: DataFrame, chunk: int, tick: float = 0.01) -> DataFrame:
    """Books from each key's latest persisted snapshot on: that book, and the one after every later message."""
    times = snapshots.select(*KEY, "seq", "ts_us").unionByName(messages(levels).select(*KEY, "seq", "ts_us")).groupBy(*KEY, "seq").agg(F.max("ts_us").alias("ts_us"))
    rows = restore_from_snapshots(snapshots, levels).join(times, [*KEY, "seq"])
    return books(rows.withColumn("price_ticks", F.round(F.col("price") / tick).cast("long")), chunk)


# --- sequence checks -------------------------------------------------------------------------


def seq_gaps(updates: DataFrame, chunk: int) -> DataFrame:
    """Gap when a delta does not continue the previous update; `missing` ids in between."""
    first = F.col("first_update_id") if "first_update_id" in updates.columns else F.col("update_id")
    first = F.when(first > 0, first).otherwise(F.col("update_id"))
    out = scan(updates, KEY, ["seq"], chunk_of("seq", chunk), last_id=prev(F.col("update_id")))
    gap = ~F.col("is_snapshot") & F.col("last_id").isNotNull() & (first != F.col("last_id") + 1)
    return out.withColumn("has_gap", F.coalesce(gap, F.lit(False))).withColumn(
        "missing", F.when(F.col("has_gap") & (first > F.col("last_id")), first - F.col("last_id") - 1)
        .otherwise(F.lit(0)).cast("long")
    )


def pu_chain(updates: DataFrame, chunk: int) -> DataFrame:
    """Whether each update still belongs to an unbroken previous-id chain since its snapshot."""
    at = chunk_of("seq", chunk)
    linked = scan(
        updates, KEY, ["seq"], at, keep_chunk=True, _last=prev(F.col("update_id")),
        epoch=cummax(F.when(F.col("is_snapshot"), F.col("seq"))),
    )
    bad = ~F.col("is_snapshot") & F.col("_last").isNotNull() & (F.col("_last") != F.col("prev_update_id"))
    linked = linked.withColumn("in_chain", ~F.coalesce(bad, F.lit(False)))
    broken = scan(linked, KEY, ["seq"], F.col(CHUNK), _bad=cummax(F.when(~F.col("in_chain"), F.col("seq"))))
    ok = F.col("epoch").isNotNull() & (F.col("_bad").isNull() | (F.col("_bad") < F.col("epoch")))
    return broken.withColumn("synchronised", ok).drop("_last", "_bad")


def snapshot_delta_sync(snapshots: DataFrame, deltas: DataFrame, chunk: int) -> DataFrame:
    """Verdict per buffered delta against the snapshot in force before it.

    stale: u <= L; the first kept delta must overlap (U <= L <= u), each later one must
    name its predecessor; after the first failure the rest of the span is rejected.
    """
    tagged = snapshots.select(*KEY, "seq", "last_update_id").unionByName(
        deltas.select(*KEY, "seq", "first_update_id", "update_id", "prev_update_id"), allowMissingColumns=True
    )
    located = scan(
        tagged, KEY, ["seq"], chunk_of("seq", chunk), keep_chunk=True,
        base=ffill(F.when(F.col("last_update_id").isNotNull(), F.struct("seq", "last_update_id"))),
    )
    fresh = located.filter(F.col("update_id").isNotNull() & F.col("base").isNotNull()).withColumn(
        "stale", F.col("update_id") <= F.col("base.last_update_id")
    )
    linked = scan(
        fresh, KEY, ["seq"], F.col(CHUNK), keep_chunk=True,
        _p=prev(F.struct("base", "update_id", "stale")),
    )
    opening = F.col("_p").isNull() | (F.col("_p.base") != F.col("base")) | F.col("_p.stale")
    overlap = (F.col("first_update_id") <= F.col("base.last_update_id")) & (F.col("base.last_update_id") <= F.col("update_id"))
    good = F.when(opening, overlap).otherwise(F.col("prev_update_id") == F.col("_p.update_id"))
    marked = linked.withColumn("_ok", F.col("stale") | good)
    out = scan(marked, KEY, ["seq"], F.col(CHUNK), _bad=cummax(F.when(~F.col("_ok"), F.col("seq")), "rows_before"))
    broken = F.coalesce(F.col("_bad") > F.col("base.seq"), F.lit(False))
    verdict = (
        F.when(F.col("stale"), "stale").when(broken, "rejected").when(~F.col("_ok"), "resync").otherwise("accepted")
    )
    return out.select(*KEY, "seq", F.col("base.seq").alias("snapshot_seq"), "first_update_id", "update_id", "prev_update_id", verdict.alias("verdict"))


# --- order-level inference -------------------------------------------------------------------


def l3_events(levels: DataFrame, chunk: int) -> DataFrame:
    """Order events implied by level changes: add, execute, cancel, with running ids per key.

    A snapshot first cancels every level still open; a zero on an absent level is ignored.
    """
    at = chunk_of("seq", chunk)
    rows = with_epoch(levels, chunk)
    changed = scan(
        rows, LEVEL, ["seq"], at, _pq=prev(F.col("quantity")), _pe=prev(F.col("epoch")), _n=following(F.col("seq")),
    )
    held = F.when(F.col("_pe") == F.col("epoch"), F.col("_pq")).otherwise(F.lit(0.0))
    changed = changed.withColumn("held", F.coalesce(held, F.lit(0.0)))
    q, h = F.col("quantity"), F.col("held")
    event = (
        F.when((q == 0) & (h > 0), F.struct(F.lit("cancel").alias("event_type"), h.alias("quantity")))
        .when(q > h, F.struct(F.lit("add").alias("event_type"), (q - h).alias("quantity")))
        .when((q < h) & (q > 0), F.struct(F.lit("execute").alias("event_type"), (h - q).alias("quantity")))
    )
    kind = F.when(F.col("side") == "bid", 1).otherwise(2)
    own = F.struct("seq", "ts_us", kind.alias("kind"), event.alias("e"))
    survives = (q > 0) & F.col("next_epoch").isNotNull() & (
        F.col("_n").isNull() | (F.col("_n") >= F.col("next_epoch"))
    )
    cleared = F.struct(
        F.col("next_epoch").alias("seq"), F.col("next_epoch_ts").alias("ts_us"), F.lit(0).alias("kind"),
        F.struct(F.lit("cancel").alias("event_type"), q.alias("quantity")).alias("e"),
    )
    both = F.array_compact(F.array(F.when(event.isNotNull(), own), F.when(survives, cleared)))
    flat = changed.select(*LEVEL, "price", F.explode(both).alias("x")).select(
        *LEVEL, "price", "x.seq", "x.ts_us", "x.kind", "x.e.event_type", "x.e.quantity"
    )
    return numbered(flat, ["seq", "kind", "side", "price_ticks"], at, "order_id").drop("kind")


def order_flow_imbalance_l3(order_events: DataFrame, lookback_ms: int) -> DataFrame:
    """Add quantity bid against ask within the lookback of each message."""
    adds = F.col("event_type") == "add"
    per = order_events.groupBy(*KEY, "seq", "ts_us").agg(
        F.sum(F.when(adds & (F.col("side") == "bid"), F.col("quantity")).otherwise(0.0)).alias("buy"),
        F.sum(F.when(adds & (F.col("side") == "ask"), F.col("quantity")).otherwise(0.0)).alias("sell"),
    )
    look = lookback_ms * 1000
    out = sliding(per, KEY, "ts_us", look, 4 * look, _b=total(F.col("buy")), _s=total(F.col("sell")))
    return out.withColumn("order_flow_imbalance", imbalance(F.col("_b"), F.col("_s"))).drop("_b", "_s")


# --- fixed depth -----------------------------------------------------------------------------


def fixed_depth_book(levels: DataFrame, chunk: int, depth: int = 20, rounds: int = 4) -> DataFrame:
    """Side summary after each message of a book that forgets levels beyond `depth`.

    Segments of `chunk` are replayed in parallel from guessed entries until they fit together (`operators.ladders`). A
    message whose update_id is not above all before it in its span is an old one: it is skipped and has no row.
    """
    rows = with_epoch(levels, chunk)
    if "update_id" in levels.columns:
        newest = cummax(F.col("update_id"), "range_before")
        rows = scan(rows, [*KEY, "epoch"], ["seq"], chunk_of("seq", chunk), _newest=newest)
        rows = rows.filter(F.col("_newest").isNull() | F.col("update_id").isNull() | (F.col("update_id") > F.col("_newest"))).drop("_newest")
    return truncated(rows, chunk, depth, rounds)


# --- checksums and validation ----------------------------------------------------------------


def book_checksum(books_df: DataFrame, kind: str = "crc32", depth: int = 25) -> DataFrame:
    """`checksum` of each book; replayed books carry it under the name of its kind."""
    if kind in books_df.columns:
        return books_df.withColumn("checksum", F.col(kind))
    value = bk.checksum_crc32(depth) if kind == "crc32" else bk.checksum_md5()
    return books_df.withColumn("checksum", value)


def checksum_audit(checked: DataFrame, chunk: int, max_consecutive: int = 5) -> DataFrame:
    """Per check: valid flag (a missing checksum passes), running failures and rate, length of
    the current failure run, and whether that run calls for a resync."""
    failed = F.col("received").isNotNull() & (F.col("received") != F.col("computed"))
    rows = checked.withColumn("valid", ~failed)
    counted = scan(
        rows, KEY, ["seq"], chunk_of("seq", chunk), keep_chunk=True, checks=cumsum(F.lit(1)),
        failures=cumsum((~F.col("valid")).cast("long")),
    )
    based = scan(counted, KEY, ["seq"], F.col(CHUNK), _base=ffill(F.when(F.col("valid"), F.col("failures"))))
    run = F.col("failures") - F.coalesce(F.col("_base"), F.lit(0))
    return based.withColumns({
        "consecutive_failures": run, "needs_resync": run >= max_consecutive,
        "success_rate": (F.col("checks") - F.col("failures")) / F.col("checks"),
    }).drop("_base")


def book_validation(updates: DataFrame, chunk: int, max_change_pct: float, max_stale_ms: int, as_of: Column) -> DataFrame:
    """First failing check per update, NULL when it passes.

    The mid compares with the last accepted one: that of an update with two sides that passed every check before and
    was no outlier itself.
    """
    rows = updates.withColumn("mid", F.when(bk.both_sides(), bk.mid()))
    seen = scan(rows, KEY, ["seq"], chunk_of("seq", chunk), _last_ts=cummax(F.col("ts_us"), "rows_before"))

    def unsorted(side: str, wrong) -> Column:
        shifted = F.slice(F.col(side), 2, F.greatest(F.size(side) - 1, F.lit(0)))
        pairs = F.arrays_zip(F.slice(F.col(side), 1, F.greatest(F.size(side) - 1, F.lit(0))).alias("a"), shifted.alias("b"))
        return F.exists(pairs, lambda p: wrong(p["a"]["price"], p["b"]["price"]))

    every = F.concat("bids", "asks")
    early = (
        F.when(F.col("ts_us") < F.col("_last_ts"), "non_monotonic")
        .when((as_of - F.col("ts_us")) / 1000 > max_stale_ms, "stale")
        .when(unsorted("bids", lambda a, b: b >= a), "bids_unsorted")
        .when(unsorted("asks", lambda a, b: b <= a), "asks_unsorted")
        .when(F.exists(every, lambda lv: lv["price"] <= 0), "invalid_price")
        .when(F.exists(every, lambda lv: lv["quantity"] < 0), "invalid_quantity")
        .when(bk.both_sides() & (bk.best("bids", "price") >= bk.best("asks", "price")), "crossed")
    )
    checked = seen.withColumn("_early", early).drop("_last_ts")
    inputs = {"eligible": F.col("_early").isNull(), "mid": F.col("mid")}
    folded = streamed_fold(checked, KEY, chunk_of("seq", chunk), ["seq"], inputs, LastAccepted(max_change_pct))
    verdict = F.coalesce(F.col("_early"), F.when(F.col("is_outlier"), "outlier"))
    return folded.withColumn("violation", verdict).drop("_early", "is_outlier", "last_accepted")
