"""The builder's states: known paths, and the parallel form against row by row for all chunk widths."""

from __future__ import annotations

import random

import pytest

from tickloom.operators.builder import Builder, builder_states

SCHEMA = "exchange string, symbol string, seq long, ts_us long, update_id long, first_update_id long, is_snapshot boolean, checksum_ok boolean, crossed boolean, manual boolean"
SECOND = 1_000_000


def path(spark, rows, chunk=3, **options):
    """rows: (second, update_id, snapshot, trouble); returns (state, reason, attempt) by row."""
    full = [("x", "s", i, int(t * SECOND), u, 0, snap, wrong != "checksum", wrong == "crossed", wrong == "manual") for i, (t, u, snap, wrong) in enumerate(rows)]
    out = builder_states(spark.createDataFrame(full, SCHEMA), chunk, **options).orderBy("seq").collect()
    return [(r.state, r.reason, r.attempt) for r in out], out


def test_every_reason(spark):
    states, out = path(spark, [
        (0, 1, False, None), (1, 5, True, None), (2, 6, False, None), (3, 9, False, None), (3.05, 10, False, None), (4, 20, True, None),
        (5, 21, False, "checksum"), (6, 30, True, None), (7, 31, False, "crossed"), (8, 40, True, None), (9, 41, False, "manual"), (9.5, 42, False, None), (39.2, 43, False, None)])
    assert states == [
        ("buffering", "initial", 0), ("live", None, 0), ("live", None, 0), ("resync", "gap", 1), ("resync", "gap", 1), ("live", None, 0), ("resync", "checksum", 1),
        ("live", None, 0), ("resync", "crossed", 1), ("live", None, 0), ("resync", "manual", 1), ("buffering", "manual", 1), ("resync", "timeout", 2)]
    assert [r.initialised for r in out] == [i in (1, 5, 7, 9) for i in range(13)]
    last = out[-1]
    assert (last.applied, last.gaps, last.resyncs, last.resyncs_ok, last.resyncs_failed) == (8, 1, 5, 3, 0)
    assert [r.buffered for r in out] == [1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1, 1]


def test_attempts_run_out_and_the_builder_starts_anew(spark):
    # timeouts at 10, 21, 33 (back-off 1 and 2 s), error rests 5 s until 38, anew
    rows = [(t, int(t) + 1, False, None) for t in (0, 10, 11.5, 21, 24, 33, 37, 38, 48)] + [(10_000, 1, False, None), (10_001, 7, True, None)]
    states, out = path(spark, rows, 4, snapshot_timeout_s=10, max_attempts=2, backoff_ms=1000)
    assert states[:9] == [
        ("buffering", "initial", 0), ("resync", "timeout", 1), ("buffering", "timeout", 1), ("resync", "timeout", 2), ("buffering", "timeout", 2), ("error", "timeout", 3),
        ("error", "timeout", 3), ("buffering", "initial", 0), ("resync", "timeout", 1)]
    assert out[8].resyncs_failed == 1 and out[9].resyncs_failed == 10_000 // 38 and states[10][0] == "live"


def test_a_full_buffer_drops_its_oldest(spark):
    _, out = path(spark, [(0, i, False, None) for i in range(12)], 5, max_buffer=4)
    assert [(r.buffered, r.dropped) for r in out] == [(1, 0), (2, 0), (3, 0), (4, 0), (1, 4), (2, 4), (3, 4), (4, 4), (1, 8), (2, 8), (3, 8), (4, 8)]


def random_rows(seed, n=300):
    rnd, out, ts, ids = random.Random(seed), [], {}, {}
    for i in range(n):
        key = rnd.choice(["hot", "hot", "cold", None])
        ts[key] = ts.get(key, 0) + rnd.choice([0, 1, 5, 40, 400, 9000, -30])
        step = rnd.choice([1] * 6 + [2, 3])
        ids[key] = ids.get(key, 0) + step
        first = rnd.choice([0, ids[key] - step + 1, ids[key]])
        out.append((key, "s", i, ts[key], ids[key], first, rnd.random() < 0.06, rnd.choice([True] * 15 + [False, None]), rnd.random() < 0.03, rnd.random() < 0.03))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chunks_of_any_width_give_the_path_row_by_row(spark, seed):
    rows = random_rows(seed)
    options = {"snapshot_timeout_s": 1e-4, "max_attempts": 2, "error_wait_s": 1e-4}
    fold, state, want = Builder(100, 2, 1_000, 100), {}, {}
    for key, _, seq, ts, update_id, first, *flags in rows:
        state[key], out = fold.step(state.get(key), ts, update_id, first, *flags)
        want[seq] = out
    names = [f.split()[0] for f in fold.outputs.split(", ")]
    assert len({w[0] for w in want.values()}) == 4
    for chunk in (1, 4, 37, 10_000):
        got = builder_states(spark.createDataFrame(rows, SCHEMA), chunk, backoff_ms=1, **options).collect()
        for r in got:
            assert [r[n] for n in names if n != "held"] == [v for n, v in zip(names, want[r.seq]) if n != "held"], (chunk, r.seq)


# --- live ------------------------------------------------------------------------------------

LIVE = "exchange string, symbol string, seq long, ts_us long, update_id long, first_update_id long, is_snapshot boolean, side string, price_ticks long, quantity double, pos long"


def live(spark, tmp_path, batches, timers=False, **options):
    from pyspark.sql import functions as F

    from tickloom.streaming import jobs

    for i, rows in enumerate(batches):
        full = [((*key, "x")[0], "s", seq, int(t * SECOND), u, first, snap, side, tick, q, seq) for seq, t, u, first, snap, side, tick, q, *key in rows]
        spark.createDataFrame(full, LIVE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LIVE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    if timers:
        stream = stream.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", "0 seconds")
    out = jobs.run_available_now(spark, jobs.stream_book_builder(stream, timers=timers, **options), "live")
    return sorted(out.collect(), key=lambda r: (r.seq is None, r.seq or 0))


def test_held_deltas_are_replayed_after_an_older_snapshot(spark, tmp_path):
    """Deltas 11 to 13 wait over two micro-batches; the snapshot stands at 11, so 12 and 13 are applied to it, a range as well."""
    got = live(spark, tmp_path, [
        [(1, 1, 11, 0, False, "bid", 100, 9.0), (2, 2, 12, 0, False, "bid", 101, 2.0)],
        [(3, 3, 13, 0, False, "bid", 90, 0.0), (4, 4, 11, 0, True, "bid", 90, 5.0), (5, 5, 16, 14, False, "ask", 110, 1.0)],
        [(6, 6, 17, 0, False, "ask", 110, 0.0), (7, 7, 19, 0, False, "bid", 102, 1.0), (8, 7.05, 20, 0, False, "bid", 103, 1.0)],
    ])
    assert [(r.state, r.reason, r.levels, r.best_bid_ticks, r.replayed) for r in got] == [
        ("buffering", "initial", 0, None, 0), ("buffering", "initial", 0, None, 0), ("buffering", "initial", 0, None, 0), ("live", None, 1, 101, 2),
        ("live", None, 2, 101, 0), ("live", None, 1, 101, 0), ("resync", "gap", 0, None, 0), ("resync", "gap", 0, None, 0)]
    assert [[(c.side, c.price_ticks, c.quantity) for c in r.changed] for r in got[3:6]] == [
        [("bid", 90, 0.0), ("bid", 101, 2.0)], [("ask", 110, 1.0)], [("ask", 110, 0.0)]]


def test_a_full_live_buffer_keeps_its_newest(spark, tmp_path):
    rows = [(i, i, 100 + i, 0, False, "bid", i, 1.0) for i in range(1, 21)]
    got = live(spark, tmp_path, [rows[:9], rows[9:], [(30, 21, 100, 0, True, "ask", 999, 1.0)]], max_buffer=4)
    assert (got[-1].state, got[-1].replayed, got[-1].levels, got[-1].best_bid_ticks) == ("live", 4, 5, 20)


def test_timers_speak_for_a_silent_builder(spark, tmp_path):
    """Another key's rows move the watermark past the end of the wait; the row without seq says so."""
    got = live(spark, tmp_path, [[(i, 1000 + t, i, 0, False, "bid", 1, 1.0, key)] for i, t, key in ((1, 0, "x"), (2, 9, "y"), (3, 10.05, "y"), (4, 10.06, "y"))],
               timers=True, snapshot_timeout_s=10)
    assert [(r.exchange, r.state, r.reason, r.attempt) for r in got if r.seq is None] == [("x", "resync", "timeout", 1)]
    assert [r.seq for r in got if r.seq is not None] == [1, 2, 3, 4]
