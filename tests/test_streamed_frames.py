"""Processors take a key's micro-batch frame by frame, in an order that Spark brings."""

from __future__ import annotations

import pandas as pd

from tickloom.streaming import processors as p


class Value:
    """Stands in for a state variable."""

    def __init__(self):
        self.held, self.map = None, {}

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None

    def iterator(self):
        return iter(self.map.items())

    def updateValue(self, key, value):
        self.map[key] = value


def fed(frames: list[pd.DataFrame], taken: list[int]):
    for i, frame in enumerate(frames):
        taken.append(i)
        yield frame


def test_nbbo_answers_each_frame_before_the_next_is_read(spark):
    quotes = pd.DataFrame({"exchange": ["a", "b"] * 3, "ts_us": range(6), "seq": range(6), "best_bid": [1.0, 2, 3, 4, 5, 6], "bid_qty": 1.0, "best_ask": 9.0, "ask_qty": 1.0})
    one = p.Nbbo(1000)
    one.tops, taken = Value(), []
    out = one.handleInputRows(("s",), fed([quotes[i : i + 2] for i in (0, 2, 4)], taken), None)
    first = next(out)
    assert taken == [0] and first["best_bid"].tolist() == [1.0, 2.0]
    assert [f["best_bid"].tolist() for f in out] == [[3.0, 4.0], [5.0, 6.0]] and set(one.tops.map) == {("a",), ("b",)}


def test_positions_take_frames_one_at_a_time(spark):
    fills = pd.DataFrame({"side": ["buy", "buy", "sell", "sell"], "quantity": [1.0, 3.0, 2.0, 4.0], "price": [10.0, 14.0, 15.0, 12.0]})
    one = p.Positions(["ts_us"])
    one.position, sizes = Value(), []

    class Short(list):
        def __iter__(self):
            for frame in (fills[:1], fills[1:3], fills[3:]):
                sizes.append(one.position.held is None)
                yield frame.reset_index(drop=True)

    (row,) = list(one.handleInputRows(("x", "s"), iter(Short()), None))
    assert one.order == ("ts_us",) and sizes == [True] * 3
    assert row.iloc[0].tolist() == ["x", "s", -2.0, 12.0, 2 * (15 - 13) + 2 * (12 - 13), 4]


def test_the_batch_is_sorted_by_spark(spark, tmp_path):
    """Arrow batches of two rows and files in the wrong order: only a sort of the whole micro-batch gives the right average."""
    from tickloom.streaming import jobs

    rows = [("x", "s", i, "buy" if i % 3 else "sell", float(i % 5 + 1), 100.0 + i) for i in range(20)]
    names = "exchange string, symbol string, ts_us long, side string, quantity double, price double"
    spark.createDataFrame(rows[::-1], names).repartition(3).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        stream = spark.readStream.schema(names).parquet(str(tmp_path / "in"))
        (got,) = jobs.run_available_now(spark, jobs.stream_positions(stream, ["ts_us"]), "p").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    one = p.Positions(["ts_us"])
    one.position = Value()
    (want,) = list(one.handleInputRows(("x", "s"), iter([pd.DataFrame(rows, columns=[c.split()[0] for c in names.split(", ")])]), None))
    assert list(got) == want.iloc[0].tolist()
    assert spark.conf.get("spark.sql.streaming.unsupportedOperationCheck", "true") == "true"


def test_a_message_may_span_frames(spark):
    from tickloom.operators.builder import machine

    rows = pd.DataFrame({
        "seq": [1, 1, 1, 2, 2], "ts_us": [5, 9, 7, 10, 10], "is_snapshot": [False, False, True, False, False], "side": ["bid", "bid", "bid", "ask", "ask"],
        "price_ticks": [1, 2, 1, 8, 8], "quantity": [1.0, 2.0, 3.0, 4.0, 0.0]})
    builder, taken = p.BookBuilder(machine(30, 5, 100, 5)), []
    got = builder._messages(fed([rows[:2], rows[2:4], rows[4:]], taken))
    seq, row, entries = next(got)
    assert taken == [0, 1] and (seq, row.ts, row.snapshot, entries) == (1, 9, True, [("bid", 1, 3.0), ("bid", 2, 2.0)])
    ((seq, row, entries),) = got
    assert (seq, row.ts, row.snapshot, entries) == (2, 10, False, [("ask", 8, 0.0)]) and builder.order == ("seq", "pos")


def test_sides_meet_over_frames(spark):
    rows = pd.DataFrame({"seq": [1, 2, 3], "side": ["bid", "ask", "bid"], "is_last": [True, True, True], "levels": [[1], [2], [3]]})
    one, taken = p.BookSides(), []
    one.sides = {"bid": Value(), "ask": Value()}
    out = one.handleInputRows(("x", "s"), fed([rows[i : i + 1] for i in range(3)], taken), None)
    assert next(out).empty and taken == [0]
    assert [f[["seq", "bids", "asks"]].values.tolist() for f in out] == [[[2, [1], [2]]], []]
    assert one.sides["bid"].held == ([3],) and one.sides["ask"].held is None


def test_builder_sends_out_wide_messages_early(spark, monkeypatch):
    from tickloom.operators.builder import machine

    monkeypatch.setattr(p, "LEVELS", 3)
    rows = pd.DataFrame([(m, m, m == 1, "bid", t, float(m)) for m in (1, 2, 3) for t in (1, 2)],
                        columns=["seq", "ts_us", "is_snapshot", "side", "price_ticks", "quantity"])
    one = p.BookBuilder(machine(30, 5, 100, 5), ())
    one.levels, one.buffer, one.sync = Value(), Value(), Value()
    one.buffer.held = []
    assert [f["seq"].tolist() for f in one.handleInputRows(("x", "s"), iter([rows]), None)] == [[1, 2], [3]]
