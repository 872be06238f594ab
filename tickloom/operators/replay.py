"""Books by replay: a ladder checkpoint at the start of every chunk, then the chunk's updates in order.

The live levels at a chunk's start follow from one row per level and chunk, its last state there: it holds until the
next chunk that touches the level or has a snapshot. So checkpoints need neither the path inside the
chunks nor a task that sees a whole key. Each chunk is then replayed on its own from sorted Arrow batches. The
ladder keeps its sides sorted and its depth sums up to date: an update changes the sums by itself, and a moved mid by the
levels that cross the edge of a band. A message costs its updates and these crossings, not the depth of the book.

Sums are kept in whole units of 1e-8, so they depend on the book alone and not on the path or the chunk width.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.ordered import CHUNK, chunk_of
from tickloom.session import ship_by_value

KEY = ["exchange", "symbol"]
UNIT = 10**8
MESSAGES = 4_096


def band_name(bps: float) -> str:
    return f"{bps:g}bps"


def same_key(a: str, b: str, columns: list[str]):
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def chunk_marks(levels: DataFrame, chunk: int) -> DataFrame:
    """Per key and chunk: its number among the chunks that have messages, its last snapshot, the next chunk with one, the key's first."""
    snap = F.when(F.col("is_snapshot"), F.col("seq"))
    seen = levels.groupBy(*KEY, chunk_of("seq", chunk).alias(CHUNK)).agg(F.max(snap).alias("snap"), F.min(snap).alias("first_snap"))
    along = Window.partitionBy(*KEY).orderBy(CHUNK)
    no = F.row_number().over(along)
    return seen.withColumn("no", no).withColumns({
        "begun": F.min("first_snap").over(Window.partitionBy(*KEY)), "last_no": F.max("no").over(Window.partitionBy(*KEY)),
        "snap_no": F.min(F.when(F.col("snap").isNotNull(), F.col("no"))).over(along.rowsBetween(1, Window.unboundedFollowing)),
    })


def ladder_checkpoints(levels: DataFrame, chunk: int, marks: DataFrame) -> DataFrame:
    """The levels in force before the first message of each chunk: exchange, symbol, chunk, side, price_ticks, price, quantity."""
    level = [*KEY, "side", "price_ticks"]
    ends = levels.groupBy(*level, chunk_of("seq", chunk).alias(CHUNK)).agg(F.max_by(F.struct("seq", "price", "quantity"), "seq").alias("s"))
    placed = ends.alias("e").join(marks.alias("m"), same_key("e", "m", [*KEY, CHUNK])).select(
        *[f"e.{c}" for c in level], "e.s", *[f"m.{c}" for c in ("no", "snap", "begun", "snap_no", "last_no")])
    placed = placed.withColumn("next_no", F.lead("no").over(Window.partitionBy(*level).orderBy("no")))
    cleared = F.coalesce(F.col("snap") > F.col("s.seq"), F.lit(False))
    until = F.least("next_no", "snap_no", "last_no")
    live = placed.where((F.col("s.quantity") > 0) & (F.col("s.seq") >= F.col("begun")) & ~cleared & (until > F.col("no")))
    held = live.select(*level, "s.price", "s.quantity", F.explode(F.sequence(F.col("no") + 1, until)).alias("no"))
    return held.alias("h").join(marks.select(*KEY, CHUNK, "no").alias("n"), same_key("h", "n", [*KEY, "no"])).select(
        *[f"h.{c}" for c in level], "h.price", "h.quantity", f"n.{CHUNK}")


class Side:
    """One side of a ladder, best first, with running sums over the levels inside each band."""

    def __init__(self, sign: int, bands: int, spelled: bool):
        self.sign, self.bands, self.spelled = sign, range(bands), spelled
        self.clear()

    def clear(self) -> None:
        self.ranks, self.prices, self.quantities, self.units, self.values, self.texts = [], [], [], [], [], []
        self.inside, self.volume, self.notional = [[0] * len(self.bands) for _ in range(3)]

    def put(self, ticks: int, price: float, quantity: float | None) -> None:
        rank = self.sign * ticks
        at = bisect_left(self.ranks, rank)
        if at < len(self.ranks) and self.ranks[at] == rank:
            for b in self.bands:
                if at < self.inside[b]:
                    self.inside[b] -= 1
                    self.volume[b] -= self.units[at]
                    self.notional[b] -= self.values[at]
            for column in (self.ranks, self.prices, self.quantities, self.units, self.values):
                del column[at]
            if self.spelled:
                del self.texts[at]
        if quantity is None or not quantity > 0:
            return
        units = round(quantity * UNIT)
        value = round(price * UNIT) * units
        for column, x in ((self.ranks, rank), (self.prices, price), (self.quantities, quantity), (self.units, units), (self.values, value)):
            column.insert(at, x)
        if self.spelled:
            self.texts.insert(at, f"{plain(price)}:{plain(quantity)}")
        for b in self.bands:
            if at < self.inside[b]:
                self.inside[b] += 1
                self.volume[b] += units
                self.notional[b] += value

    def reach(self, b: int, centre: float, limit: float) -> None:
        """Move the edge of a band to the levels no further than `limit` from the centre."""
        away = (lambda p: p - centre) if self.sign > 0 else (lambda p: centre - p)
        now, was = bisect_right(self.prices, limit, key=away), self.inside[b]
        if now > was:
            self.volume[b] += sum(self.units[was:now])
            self.notional[b] += sum(self.values[was:now])
        elif now < was:
            self.volume[b] -= sum(self.units[now:was])
            self.notional[b] -= sum(self.values[now:was])
        self.inside[b] = now


def plain(x: float) -> str:
    """Up to eight decimals, half up, without trailing zeros."""
    text = f"{x:.8f}"
    if float(text) != x:
        text = str(Decimal(repr(x)).quantize(Decimal("1e-8"), ROUND_HALF_UP))
    return text.rstrip("0").rstrip(".")


def md5_of(bids: list[str], asks: list[str]) -> str:
    return md5("".join(["".join(f"{t}|" for t in bids), "||", "".join(f"{t}|" for t in asks)]).encode()).hexdigest()


def crc32_of(bids: list[str], asks: list[str], depth: int) -> str:
    bids, asks = bids[:depth], asks[:depth]
    turns = [t for i in range(max(len(bids), len(asks))) for side in (bids, asks) for t in side[i : i + 1]]
    return f"{zlib.crc32(':'.join(turns).encode()):08x}"


class Out:
    """Columns of finished messages, turned into an Arrow batch now and then."""

    def __init__(self, names: list[str], depth: int | None):
        self.names, self.depth = names, depth
        self.rows: list[tuple] = []
        self.levels = {"bids": ([0], [], []), "asks": ([0], [], [])}

    def book(self, side: str, prices: list[float], quantities: list[float]) -> None:
        offsets, p, q = self.levels[side]
        p += prices[: self.depth]
        q += quantities[: self.depth]
        offsets.append(len(p))

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        plain_columns = zip(*self.rows) if self.rows else [[] for _ in self.names]
        columns = [pa.array(list(c), schema.field(n).type) for n, c in zip(self.names, plain_columns)]
        if self.depth != 0:
            for offsets, p, q in self.levels.values():
                level = pa.StructArray.from_arrays([pa.array(p, pa.float64()), pa.array(q, pa.float64())], names=["price", "quantity"])
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), level))
        return pa.record_batch(columns, schema=schema)


LEVELS = pa.list_(pa.struct([("price", pa.float64()), ("quantity", pa.float64())]))


def arrow_schema(bands: tuple[float, ...], depth: int | None, checksums: tuple[str, ...]) -> pa.Schema:
    fields = [("exchange", pa.string()), ("symbol", pa.string()), ("seq", pa.int64()), ("ts_us", pa.int64())]
    fields += [(c, pa.float64()) for c in ("best_bid", "bid_qty", "best_ask", "ask_qty")]
    fields += [("bid_levels", pa.int32()), ("ask_levels", pa.int32())]
    fields += [(f"{side}_{what}_{band_name(b)}", pa.float64()) for b in bands for side in ("bid", "ask") for what in ("volume", "notional")]
    fields += [(kind, pa.string()) for kind in checksums]
    if depth != 0:
        fields += [("bids", LEVELS), ("asks", LEVELS)]
    return pa.schema(fields)


_SQL_TYPE = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", LEVELS: "array<struct<price:double,quantity:double>>"}


def _replayer(bands: tuple[float, ...], depth: int | None, checksums: tuple[str, ...], crc_depth: int):
    schema = arrow_schema(bands, depth, checksums)
    names = [f.name for f in schema if f.name not in ("bids", "asks")]

    def measured(key: tuple, seq: int, ts: int, bids: Side, asks: Side, out: Out) -> None:
        both = bool(bids.prices and asks.prices)
        row = [*key, seq, ts]
        for side in (bids, asks):
            row += (side.prices[0], side.quantities[0]) if side.prices else (None, None)
        row += (len(bids.prices), len(asks.prices))
        centre = (bids.prices[0] + asks.prices[0]) / 2 if both else None
        for b, bps in enumerate(bands):
            for side in (bids, asks):
                if both:
                    side.reach(b, centre, centre * float(bps) / 10_000)
                    row += (side.volume[b] / UNIT, side.notional[b] / UNIT**2)
                else:
                    row += (0.0, 0.0)
        for kind in checksums:
            row.append(md5_of(bids.texts, asks.texts) if kind == "md5" else crc32_of(bids.texts, asks.texts, crc_depth))
        out.rows.append(tuple(row))
        if depth != 0:
            out.book("bids", bids.prices, bids.quantities)
            out.book("asks", asks.prices, asks.quantities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bids, asks = Side(-1, len(bands), bool(checksums)), Side(1, len(bands), bool(checksums))
        out = Out(names, depth)
        here, message, ts, begun = None, None, None, False
        for batch in batches:
            for exchange, symbol, chunk, kind, seq, at, snapshot, side, ticks, price, quantity in zip(*[c.to_pylist() for c in batch.columns]):
                if message is not None and (seq != message or kind == 0 or here != (exchange, symbol, chunk)):
                    measured(here[:2], message, ts, bids, asks, out)
                    message = None
                    if len(out.rows) >= MESSAGES:
                        yield out.batch(schema)
                        out = Out(names, depth)
                if kind == 0:  # where a chunk starts
                    if here != (exchange, symbol, chunk):
                        here, begun = (exchange, symbol, chunk), False
                        bids.clear()
                        asks.clear()
                    begun = begun or snapshot
                elif not begun and not snapshot:
                    continue
                elif message is None:
                    message, ts, begun = seq, at, True
                    if snapshot:
                        bids.clear()
                        asks.clear()
                if kind:
                    ts = max(ts, at)
                if side is not None:
                    (bids if side == "bid" else asks).put(ticks, price, quantity)
        if message is not None:
            measured(here[:2], message, ts, bids, asks, out)
        if out.rows:
            yield out.batch(schema)

    return run, ", ".join(f"{f.name} {_SQL_TYPE[f.type]}" for f in schema)


def replayed(
    levels: DataFrame, chunk: int, bands: tuple[float, ...] = (), depth: int | None = 0, checksums: tuple[str, ...] = (), crc_depth: int = 25,
) -> DataFrame:
    """One row per message from the first snapshot of its key on, also where a message empties the book.

    Columns: exchange, symbol, seq, ts_us, best_bid, bid_qty, best_ask, ask_qty (NULL on an empty side), bid_levels,
    ask_levels; for each band of the mid, in basis points, `<side>_volume_<band>` and `<side>_notional_<band>` (0 without two sides); the
    checksums asked for (`md5` over all levels, `crc32` over the first `crc_depth`); unless `depth` is 0, `bids` and
    `asks` as arrays of at most `depth` levels, best first (None: all). Volumes count in units of 1e-8.
    """
    run, schema = _replayer(bands, depth, checksums, crc_depth)
    marks = chunk_marks(levels, chunk)
    columns = [*KEY, CHUNK, "kind", "seq", "ts_us", "is_snapshot", "side", "price_ticks", "price", "quantity"]

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        kinds = {"ts_us": "long", "is_snapshot": "boolean", "side": "string", "price_ticks": "long", "price": "double", "quantity": "double", "seq": "long"}
        have = df.withColumn("kind", F.lit(kind))
        return have.select(*[F.col(c).cast(kinds[c]) if c in df.columns and c in kinds else F.col(c) if c in have.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns])

    starts = marks.select(*KEY, CHUNK, F.coalesce(F.col("begun") < F.col(CHUNK) * chunk, F.lit(False)).alias("is_snapshot"))
    held = ladder_checkpoints(levels, chunk, marks).withColumn("is_snapshot", F.lit(True))
    rows = shaped(levels.withColumn(CHUNK, chunk_of("seq", chunk)), 1).unionByName(shaped(starts, 0)).unionByName(shaped(held, 0))
    order = [*KEY, CHUNK, "kind", "seq", "side", "price_ticks"]
    return rows.repartition(*[F.col(c) for c in (*KEY, CHUNK)]).sortWithinPartitions(*order).mapInArrow(run, schema)


ship_by_value(__name__)
