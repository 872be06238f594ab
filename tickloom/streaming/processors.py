"""Keyed state of the live operators. Rows of a key arrive as short pandas frames, already in the order
of the processor (`jobs._keyed` has Spark sort them), and go on frame by frame, so a worker never holds a key's
micro-batch. State is read once and written once per key and batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators.builder import Builder, Row, State
from tickloom.session import ship_by_value

ship_by_value(__name__)

MESSAGES = 1_024  # rows that wait to go out
LEVELS = 16_384  # changed levels that wait with them, but for those of the last message

class Inversions(StatefulProcessor):
    """Running inversion counters per key; one row per key and micro-batch."""

    schema = (
        "exchange string, symbol string, packets long, inversions long, max_inversion_ms long, sum_inversion_ms long, "
        "last_ms long"
    )
    state = "last_ms long, packets long, inversions long, max_ms long, sum_ms long"
    order = ("recv_ms", "event_id")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, n, inv, top, total = self.seen.get() if self.seen.exists() else (None, 0, 0, 0, 0)
        for frame in rows:
            for ms in frame["exchange_ms"].tolist():
                n += 1
                if last is not None and ms < last:
                    inv, top, total = inv + 1, max(top, last - ms), total + last - ms
                last = ms
        self.seen.update((last, n, inv, top, total))
        yield pd.DataFrame([(*key, n, inv, top, total, last)], columns=[c.split()[0] for c in self.schema.split(", ")])

    def close(self) -> None:
        pass


class BookBuilder(StatefulProcessor):
    """Level rows to book states, by the state machine of `operators.builder`.

    While the builder waits, deltas are held in list state; the snapshot that ends the wait replays those with newer ids.
    The ladder is map state from (side, tick) to quantity. Only touched levels are written back, and a message's row carries just
    the levels it changed: all of them after a snapshot, none while out of step. With `timers`, a builder whose wait runs out without
    rows says so itself: a row without seq once the watermark has passed that time.
    """

    schema = (
        "exchange string, symbol string, seq long, state string, reason string, attempt long, best_bid_ticks long, best_ask_ticks long, levels long, "
        "replayed long, changed array<struct<side:string,price_ticks:long,quantity:double>>"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {c: "Int64" for c in ("seq", "attempt", "best_bid_ticks", "best_ask_ticks", "levels", "replayed")}

    def __init__(self, machine: Builder, order: tuple[str, ...] = ("pos",), max_buffer: int = 10_000, timers: bool = False):
        self.machine, self.order, self.max_buffer, self.timers = machine, ("seq", *order), max_buffer, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "side string, tick long", "quantity double")
        self.buffer = handle.getListState("buffer", "seq long, update_id long, side string, tick long, quantity double")
        self.sync = handle.getValueState(
            "sync", "mode string, reason string, attempt long, since long, cycle long, last_id long, applied long, gaps long, resyncs long, "
            "resyncs_ok long, resyncs_failed long, buffered long")

    def _loaded(self) -> tuple[State | None, int]:
        if not self.sync.exists():
            return None, 0
        *state, buffered = self.sync.get()
        return State(*state), buffered

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, buffered = self._loaded()
        held = {tuple(k): v[0] for k, v in self.levels.iterator()}
        before, out, waiting = dict(held), [], 0
        for seq, row, entries in self._messages(rows):
            met = self.machine.wait(State("buffering", "initial", 0, row.ts, row.ts) if state is None else state, row.ts)
            state, replayed, changed = self.machine.after(met, row), 0, {}
            if row.snapshot:
                changed = {level: 0.0 for level in held}
                held = {}
                self._apply(held, changed, entries)
                if state.mode == "live":
                    state, replayed = self._replay(state, held, changed)
                if buffered:
                    self.buffer.clear()
                    buffered = 0
            elif met.mode != "live":
                buffered = self._hold(int(seq), row.update_id, entries, buffered)
            elif state.applied > met.applied:
                self._apply(held, changed, entries)
            out.append(self._said(key, int(seq), state, held, replayed, changed))
            waiting += len(out[-1][-1])
            if len(out) >= MESSAGES or waiting >= LEVELS:
                yield pd.DataFrame(out, columns=self.names).astype(self.kinds)
                out, waiting = [], 0
        for level in before.keys() - held.keys():
            self.levels.removeKey(level)
        for level, quantity in held.items():
            if before.get(level) != quantity:
                self.levels.updateValue(level, (quantity,))
        self.sync.update((*state, buffered))
        if self.timers:
            self._wake(state)
        yield pd.DataFrame(out, columns=self.names).astype(self.kinds)

    def _messages(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Row, list[tuple]]]:
        """seq, row and entries of each message, of which a level's last entry counts; a message may span frames."""
        seq, row, levels = None, None, {}
        for frame in rows:
            for at, part in frame.groupby("seq", sort=False):
                more = self._row(part)
                if row is None or at != seq:
                    if row is not None:
                        yield seq, row, [(*level, q) for level, q in levels.items()]
                    seq, row, levels = at, more, {}
                else:
                    row = row._replace(ts=max(row.ts, more.ts), snapshot=row.snapshot or more.snapshot)
                levels.update(zip(zip(part["side"], part["price_ticks"].tolist()), part["quantity"].tolist()))
        if row is not None:
            yield seq, row, [(*level, q) for level, q in levels.items()]

    def _row(self, message: pd.DataFrame) -> Row:
        def one(name, default=None):
            return message[name].iloc[0] if name in message.columns and not pd.isna(message[name].iloc[0]) else default

        ids = int(one("update_id", message["seq"].iloc[0]))
        flags = [None if one(c) is None else bool(one(c)) for c in ("checksum_ok", "crossed", "manual")]
        return Row(int(message["ts_us"].max()), ids, int(one("first_update_id", 0)), bool(message["is_snapshot"].any()), *flags)

    @staticmethod
    def _apply(held: dict, changed: dict, entries: list[tuple]) -> None:
        for side, tick, quantity in entries:
            level = (side, tick)
            if quantity == 0:
                held.pop(level, None)
            else:
                held[level] = quantity
            changed[level] = quantity

    def _replay(self, state: State, held: dict, changed: dict) -> tuple[State, int]:
        """Held deltas that are newer than the snapshot, oldest first."""
        newer: dict[tuple[int, int], list[tuple]] = {}
        for seq, update_id, side, tick, quantity in (tuple(r) for r in self.buffer.get()):
            if update_id > state.last_id:
                newer.setdefault((seq, update_id), []).append((side, tick, quantity))
        kept = sorted(newer)[-self.max_buffer :]
        for at in kept:
            self._apply(held, changed, newer[at])
        if kept:
            state = state._replace(last_id=max(u for _, u in kept), applied=state.applied + len(kept))
        return state, len(kept)

    def _hold(self, seq: int, update_id: int, entries: list[tuple], buffered: int) -> int:
        self.buffer.appendList([(seq, update_id, side, int(tick), float(quantity)) for side, tick, quantity in entries])
        if buffered + 1 < 2 * self.max_buffer:
            return buffered + 1
        rows = [tuple(r) for r in self.buffer.get()]
        newest = set(sorted({r[:2] for r in rows})[-self.max_buffer :])
        self.buffer.put([r for r in rows if r[:2] in newest])
        return len(newest)

    def _said(self, key, seq: int | None, state: State, held: dict, replayed: int, changed: dict) -> tuple:
        live = state.mode == "live"
        bids = [t for s, t in held if s == "bid"] if live else []
        asks = [t for s, t in held if s == "ask"] if live else []
        levels = [{"side": s, "price_ticks": int(t), "quantity": float(q)} for (s, t), q in sorted(changed.items())] if live else []
        return (*key, seq, state.mode, state.reason, state.attempt, max(bids, default=None), min(asks, default=None), len(bids) + len(asks), replayed, levels)

    def _wake(self, state: State) -> None:
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        due = self.machine.due(state)
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, buffered = self._loaded()
        now = self.machine.wait(state, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self.sync.update((*now, buffered))
        self._wake(now)
        if now != state:
            yield pd.DataFrame([self._said(key, None, now, {}, 0, {})], columns=self.names).astype(self.kinds)

    def close(self) -> None:
        pass


class Nbbo(StatefulProcessor):
    """Top of book per venue of a symbol; one consolidated row per quote. Venues expire by TTL
    in processing time and are ignored earlier by the age of their quote."""

    schema = (
        "symbol string, ts_us long, seq long, num_exchanges long, num_checked long, best_bid double, bid_qty double, "
        "bid_exchange string, best_ask double, ask_qty double, ask_exchange string"
    )
    order = ("ts_us", "seq")

    def __init__(self, max_stale_ms: int, ttl_ms: int | None = None):
        self.max_stale_ms, self.ttl_ms = max_stale_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        value = "bid double, bid_qty double, ask double, ask_qty double, ts_us long"
        self.tops = handle.getMapState("tops", "exchange string", value, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tops = {k[0]: tuple(v) for k, v in self.tops.iterator()}
        changed = set()
        for frame in rows:
            out = []
            for ex, ts, seq, bid, bq, ask, aq in zip(
                frame["exchange"], frame["ts_us"].tolist(), frame["seq"].tolist(), frame["best_bid"].tolist(),
                frame["bid_qty"].tolist(), frame["best_ask"].tolist(), frame["ask_qty"].tolist(),
            ):
                tops[ex] = (bid, bq, ask, aq, ts)
                changed.add(ex)
                fresh = [(x, t) for x, t in tops.items() if (ts - t[4]) // 1000 <= self.max_stale_ms]
                bx, b = min(fresh, key=lambda e: (-e[1][0], e[0]))
                ax, a = min(fresh, key=lambda e: (e[1][2], e[0]))
                if b[0] > 0:
                    out.append((key[0], ts, seq, len(fresh), len(tops), b[0], b[1], bx, a[2], a[3], ax))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.schema.split(", ")])
        for ex in changed:
            self.tops.updateValue((ex,), tops[ex])

    def close(self) -> None:
        pass


class Positions(StatefulProcessor):
    """Average-cost position per key; one row per key and micro-batch."""

    schema = "exchange string, symbol string, quantity double, avg_price double, realised_pnl double, fills long"

    def __init__(self, order: list[str]):
        self.order = tuple(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.position = handle.getValueState("position", "quantity double, avg double, realised double, fills long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        q, avg, realised, n = self.position.get() if self.position.exists() else (0.0, 0.0, 0.0, 0)
        for frame in rows:
            for side, quantity, price in zip(frame["side"], frame["quantity"].tolist(), frame["price"].tolist()):
                dq = quantity if side == "buy" else -quantity
                if q * dq < 0:
                    realised += min(abs(dq), abs(q)) * (price - avg) * (1 if q > 0 else -1)
                after = q + dq
                if after == 0:
                    avg = 0.0
                elif q * after <= 0:
                    avg = price
                elif abs(after) > abs(q):
                    avg = (avg * abs(q) + price * abs(dq)) / abs(after)
                q, n = after, n + 1
        self.position.update((q, avg, realised, n))
        yield pd.DataFrame([(*key, q, avg, realised, n)], columns=[c.split()[0] for c in self.schema.split(", ")])

    def close(self) -> None:
        pass


class BookSides(StatefulProcessor):
    """Bids and asks arriving as separate rows; a book goes out when an `is_last` row finds both."""

    schema = "exchange string, symbol string, seq long, bids array<long>, asks array<long>"
    order = ("seq",)

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sides = {s: handle.getValueState(s, "levels array<long>", self.ttl_ms) for s in ("bid", "ask")}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {s: (v.get()[0] if v.exists() else None) for s, v in self.sides.items()}
        for frame in rows:
            out = []
            for seq, side, last, levels in zip(frame["seq"].tolist(), frame["side"], frame["is_last"], frame["levels"]):
                held[side] = list(levels)
                if last and held["bid"] is not None and held["ask"] is not None:
                    out.append((*key, seq, held["bid"], held["ask"]))
                    held = {"bid": None, "ask": None}
            yield pd.DataFrame(out, columns=["exchange", "symbol", "seq", "bids", "asks"])
        for side, value in self.sides.items():
            if held[side] is None:
                value.clear()
            else:
                value.update(([int(x) for x in held[side]],))

    def close(self) -> None:
        pass


class Reorder(StatefulProcessor):
    """Packets of one flush window, held until it is over and sent out in source-time order."""

    schema = "exchange string, symbol string, flush long, event_id long, arrival_pos long, emit_pos long"
    order = ()

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "event_id long, recv_ms long, exchange_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.held.appendList([tuple(map(int, r)) for r in frame[["event_id", "recv_ms", "exchange_ms"]].itertuples(index=False)])
        self.handle.registerTimer((int(key[2]) + 1) * self.window_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = [tuple(r) for r in self.held.get()]
        self.held.clear()
        arrival = {r[0]: i + 1 for i, r in enumerate(sorted(due, key=lambda r: (r[1], r[0])))}
        sent = sorted(due, key=lambda r: (r[2], r[0]))
        out = [(*key, r[0], arrival[r[0]], i + 1) for i, r in enumerate(sent)]
        yield pd.DataFrame(out, columns=["exchange", "symbol", "flush", "event_id", "arrival_pos", "emit_pos"])

    def close(self) -> None:
        pass
