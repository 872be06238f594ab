"""The state machine of a live book builder over recorded updates, one key in as many tasks as it has chunks.

buffering  updates are held until a snapshot comes; none within the timeout: resync (timeout)
live       updates that continue the ids are applied; a gap, a wrong checksum, a crossed book or a request: resync
resync     waits attempt x back-off, then buffers again; beyond the last attempt: error
error      waits, then starts anew (initial, no attempts used)

A snapshot makes the builder live from any state and clears the attempts. All times are those of the rows, so a replay
gives the same states. Timers run between rows as well: before a row is looked at, all that fell due by its time has happened.

Parallel form: a chunk acts on any entry state in four ways only. A waiting builder depends on nothing but time until the first
snapshot. A live one depends on the ids of the chunk's first row, then on the first trouble inside. From the first snapshot
on all entry states are one, and the path is fixed. So a chunk is described by one small tuple.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.plans.ordered import CHUNK, chunk_of, cumsum, ffill, prev, scan
from tickloom.plans.streamfold import Description, Fold, streamed_fold
from tickloom.session import ship_by_value

KEY = ["exchange", "symbol"]
DROPPED_AT_ONCE = 100


class State(NamedTuple):
    mode: str
    reason: str | None
    attempt: int
    since: int  # when this state began, in us
    cycle: int  # when the updates held now began to be collected
    last_id: int | None = None
    applied: int = 0
    gaps: int = 0
    resyncs: int = 0
    resyncs_ok: int = 0
    resyncs_failed: int = 0


COUNTERS = ("applied", "gaps", "resyncs", "resyncs_ok", "resyncs_failed")


class Row(NamedTuple):
    ts: int
    update_id: int
    first_id: int | None
    snapshot: bool
    checksum_ok: bool | None
    crossed: bool | None
    manual: bool | None

    def trouble(self) -> str | None:
        """What is wrong once the row is applied."""
        return "checksum" if self.checksum_ok is False else "crossed" if self.crossed else "manual" if self.manual else None

    def follows(self, last_id: int) -> bool:
        """An update may name a range of ids; then its first id counts."""
        first = self.first_id if self.first_id and self.first_id > 0 else self.update_id
        return last_id + 1 in (self.update_id, first)


class Builder(Fold):
    start = None
    outputs = (
        "state string, reason string, attempt int, since_us long, cycle_us long, initialised boolean, held boolean, applied long, gaps long, resyncs long, "
        "resyncs_ok long, resyncs_failed long, new_resyncs long, new_ok long, new_failed long"
    )

    def __init__(self, timeout_us: int, max_attempts: int, backoff_us: int, error_wait_us: int):
        self.timeout, self.most, self.backoff, self.rest = timeout_us, max_attempts, backoff_us, error_wait_us
        #: From a fresh start without snapshots to the next one: all timeouts, all back-offs and the wait in error.
        self.round = timeout_us * (max_attempts + 1) + backoff_us * max_attempts * (max_attempts + 1) // 2 + error_wait_us

    def troubled(self, s: State, reason: str, at: int) -> State:
        attempt, failed = s.attempt + 1, s.attempt + 1 > self.most
        return s._replace(
            mode="error" if failed else "resync", reason=reason, attempt=attempt, since=at, cycle=at, gaps=s.gaps + (reason == "gap"),
            resyncs=s.resyncs + 1, resyncs_failed=s.resyncs_failed + failed)

    def wait(self, s: State, ts: int) -> State:
        """Every timer that has run out by ts."""
        while s.mode != "live":
            if s.mode == "buffering" and s.attempt == 0 and self.round > 0 and ts - s.since >= self.round:
                n = (ts - s.since) // self.round
                at = s.since + n * self.round
                s = s._replace(reason="initial", since=at, cycle=at, resyncs=s.resyncs + n * (self.most + 1), resyncs_failed=s.resyncs_failed + n)
            due = self.due(s)
            if due > ts:
                break
            if s.mode == "buffering":
                s = self.troubled(s, "timeout", due)
            elif s.mode == "resync":
                s = s._replace(mode="buffering", since=due)
            else:
                s = s._replace(mode="buffering", reason="initial", attempt=0, since=due, cycle=due)
        return s

    def due(self, s: State) -> int | None:
        """When the current wait runs out; a live builder waits for nothing."""
        if s.mode == "live":
            return None
        return s.since + {"buffering": self.timeout, "resync": self.backoff * s.attempt, "error": self.rest}[s.mode]

    def synced(self, s: State, row: Row) -> State:
        s = s._replace(
            mode="live", reason=None, attempt=0, since=row.ts, cycle=row.ts, last_id=row.update_id, applied=s.applied + 1,
            resyncs_ok=s.resyncs_ok + (s.attempt > 0))
        return self.troubled(s, row.trouble(), row.ts) if row.trouble() else s

    def after(self, s: State, row: Row) -> State:
        """The state after a row that is met in state s."""
        if row.snapshot:
            return self.synced(s, row)
        if s.mode != "live":
            return s
        if not row.follows(s.last_id):
            return self.troubled(s, "gap", row.ts)
        s = s._replace(last_id=row.update_id, applied=s.applied + 1)
        return self.troubled(s, row.trouble(), row.ts) if row.trouble() else s

    def begin(self, state: tuple | None, ts: int) -> State:
        """The state in which a row of this time is met."""
        return self.wait(State("buffering", "initial", 0, ts, ts) if state is None else State(*state), ts)

    def step(self, state: tuple | None, *values) -> tuple[tuple, tuple]:
        row = Row(*values)
        met = self.begin(state, row.ts)
        s = self.after(met, row)
        waited = met.mode != "live"
        counters = [getattr(s, n) for n in COUNTERS]
        counters += [x - (y if state else 0) for x, y in zip(counters[2:], state[-3:] if state else (0, 0, 0))]
        return tuple(s), (s.mode, s.reason, s.attempt, s.since, s.cycle, waited and row.snapshot, waited and not row.snapshot, *counters)

    def describe(self) -> _Chunk:
        return _Chunk(self)

    def advance(self, state: tuple | None, c: dict) -> tuple:
        first = Row(*c["first"])
        s = self.begin(state, first.ts)
        if not first.snapshot:
            if s.mode != "live":
                s = self.wait(s, c["latest"])
            elif not first.follows(s.last_id):
                s = self.wait_if(self.troubled(s, "gap", first.ts), c["latest_after_first"])
            else:
                s = s._replace(last_id=c["last_id"], applied=s.applied + c["applied"])
                if c["trouble"]:
                    s = self.wait_if(self.troubled(s, c["trouble"], c["trouble_ts"]), c["latest_after_trouble"])
        if c["tail"] is None:
            return tuple(s)
        s, tail = self.wait(s, c["snap_ts"]), State(*c["tail"])
        before = s._replace(resyncs_ok=s.resyncs_ok + (s.attempt > 0))
        return tuple(tail._replace(**{n: getattr(before, n) + getattr(tail, n) for n in COUNTERS}))

    def wait_if(self, s: State, ts: int | None) -> State:
        return s if ts is None else self.wait(s, ts)


class _Chunk(Description):
    """Rows before the first snapshot as a few facts, the path from it on as the state at its end."""

    def __init__(self, fold: Builder):
        self.fold = fold
        self.facts: dict = dict.fromkeys((
            "first", "latest", "latest_after_first", "last_id", "trouble", "trouble_ts", "latest_after_trouble", "snap_ts", "tail"))
        self.facts["applied"] = 0

    def add(self, *values) -> None:
        row, c = Row(*values), self.facts
        begins = c["first"] is None
        if begins:
            c["first"] = values
        if c["tail"] is not None:
            tail = State(*c["tail"])
            c["tail"] = tuple(self.fold.after(self.fold.wait(tail, row.ts), row))
        elif row.snapshot:
            c["snap_ts"], c["tail"] = row.ts, tuple(self.fold.synced(State("live", None, 0, row.ts, row.ts), row))
        else:
            self.before_snapshot(row, begins)

    def before_snapshot(self, row: Row, begins: bool) -> None:
        c = self.facts
        self.later("latest", row.ts)
        if not begins:
            self.later("latest_after_first", row.ts)
        if c["trouble"]:
            self.later("latest_after_trouble", row.ts)
        elif not begins and not row.follows(c["last_id"]):
            c.update(trouble="gap", trouble_ts=row.ts)
        else:
            c["last_id"], c["applied"] = row.update_id, c["applied"] + 1
            if row.trouble():
                c.update(trouble=row.trouble(), trouble_ts=row.ts)

    def later(self, name: str, ts: int) -> None:
        self.facts[name] = ts if self.facts[name] is None else max(self.facts[name], ts)

    def result(self) -> dict:
        return self.facts


def machine(snapshot_timeout_s: float = 30, max_attempts: int = 5, backoff_ms: int = 100, error_wait_s: float = 5) -> Builder:
    return Builder(int(snapshot_timeout_s * 1_000_000), max_attempts, int(backoff_ms * 1000), int(error_wait_s * 1_000_000))


def builder_states(
    updates: DataFrame, chunk: int, max_buffer: int = 10_000, snapshot_timeout_s: float = 30, max_attempts: int = 5, backoff_ms: int = 100,
    error_wait_s: float = 5,
) -> DataFrame:
    """State of the builder after each update, ordered by seq inside a key.

    Needs seq, ts_us, update_id and is_snapshot; first_update_id, checksum_ok, crossed and manual are read where they are. Adds
    state, reason (initial, gap, checksum, crossed, timeout, manual; NULL when live), attempt, since_us and cycle_us (when this
    state, and the current collection of updates, began), initialised (a snapshot that ended a wait), counters up to here (applied, gaps,
    resyncs, resyncs_ok, resyncs_failed) and what the last three grew by since the row before (new_*), and how many updates the
    buffer holds and has dropped since cycle_us: a full buffer drops its 100 oldest.
    """
    fold = machine(snapshot_timeout_s, max_attempts, backoff_ms, error_wait_s)

    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in updates.columns else F.lit(None).cast(kind)

    inputs = {
        "ts": F.col("ts_us").cast("long"), "update_id": F.col("update_id").cast("long"), "first_id": given("first_update_id", "long"),
        "snapshot": F.coalesce(F.col("is_snapshot"), F.lit(False)), "checksum_ok": given("checksum_ok", "boolean"),
        "crossed": given("crossed", "boolean"), "manual": given("manual", "boolean"),
    }
    at = chunk_of("seq", chunk)
    walked = streamed_fold(updates, KEY, at, ["seq"], inputs, fold)
    one = F.col("held").cast("long")
    counted = scan(walked, KEY, ["seq"], at, keep_chunk=True, _n=cumsum(one), _c=prev(F.col("cycle_us")))
    opens = F.col("_c").isNull() | (F.col("_c") != F.col("cycle_us"))
    based = scan(counted, KEY, ["seq"], F.col(CHUNK), _base=ffill(F.when(opens, F.col("_n") - one)))
    n, at_once = F.col("_n") - F.col("_base"), min(DROPPED_AT_ONCE, max_buffer)
    dropped = F.when(n > max_buffer, F.ceil((n - max_buffer) / at_once) * at_once).otherwise(F.lit(0)).cast("long")
    return based.withColumns({"buffered": (n - dropped).cast("long"), "dropped": dropped}).drop("_n", "_c", "_base", "held")


ship_by_value(__name__)
