"""Aggregates over trailing time frames whose cost does not grow with what a frame holds.

Spark evaluates a sliding range frame anew for every row. Here rows are dealt by key and time chunk with a halo of one frame
length (`plans.ordered.with_halo`), sorted, and worked on as arrays: a frame is a stretch [start, end) of them, found by one
binary search (frames of totals and counts only: by a probe and a forward fill in the JVM). Sums are differences of prefix sums, extremes come from doubling stretches, order statistics from a wavelet
matrix. Prefix sums are kept in integers (whole units, 1e-8 and 1e-16), so they are exact and a result depends on the
rows of its frame alone, not on the chunk width. Several groups are worked on at once; of a large one as many rows are held as
twice its fullest frame has, `BLOCK` at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.ordered import CHUNK, HALO, with_halo
from tickloom.session import ship_by_value

UNIT = 1e8
BLOCK = 1 << 16
SPREAD_UNIT = 1e12
_TYPES = {"total": "double", "rows": "long", "least": "double", "greatest": "double", "earliest": "double", "spread": "double", "upper": "double", "ups": "long", "downs": "long"}


@dataclass(frozen=True)
class Measure:
    kind: str
    value: Column
    width: int | None = None
    share: float | None = None
    part: int = 0
    among: Column | str | None = None  # in the worker: the input that tells


def total(value: Column, width: int | None = None) -> Measure:
    """Sum of the values that are not NULL; NULL if there are none."""
    return Measure("total", value, width)


def rows(condition: Column | None = None, width: int | None = None) -> Measure:
    """Rows for which the condition holds; all without one."""
    return Measure("rows", F.lit(1.0) if condition is None else F.when(condition, F.lit(1.0)), width)


def least(value: Column, width: int | None = None) -> Measure:
    return Measure("least", value, width)


def greatest(value: Column, width: int | None = None) -> Measure:
    return Measure("greatest", value, width)


def earliest(value: Column, width: int | None = None) -> Measure:
    """The first value of the frame, in its order, that is not NULL."""
    return Measure("earliest", value, width)


def spread(value: Column, width: int | None = None) -> Measure:
    """Population standard deviation."""
    return Measure("spread", value, width)


def upper_part(value: Column, share: float, width: int | None = None) -> tuple[Measure, Measure, Measure]:
    """With the sizes |value| of a frame in order, the one at min(floor(n share), n - 1); the sum of the values of at least that size,
    and that of their sizes. Values must not be NULL."""
    return tuple(Measure("upper", value, width, share, part) for part in range(3))


def moves(value: Column, among: Column, width: int | None = None) -> tuple[Measure, Measure]:
    """How often the value rises and falls from one row to the next, of the rows of the frame for which `among` holds.
    Next to a NULL there is no move."""
    return tuple(Measure(kind, value, width, among=F.when(among, F.lit(1.0))) for kind in ("ups", "downs"))


class Sums:
    """Exact sums of stretches of an array."""

    def __init__(self, values: np.ndarray):
        bad = ~np.isfinite(values)
        clean = np.where(bad, 0.0, values)
        whole = np.floor(clean)
        rest = (clean - whole) * UNIT
        fine = np.floor(rest)
        self.parts = [prefix(whole.astype(np.int64)), prefix(fine.astype(np.int64)), prefix(np.rint((rest - fine) * UNIT).astype(np.int64))]
        self.bad = prefix(bad.astype(np.int64)) if bad.any() else None

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        whole, fine, finest = [p[end] - p[start] for p in self.parts]
        out = whole + (fine + finest / UNIT) / UNIT
        return out if self.bad is None else np.where(self.bad[end] > self.bad[start], np.nan, out)


def prefix(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def extremes(values: np.ndarray, start: np.ndarray, end: np.ndarray, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each non-empty stretch: two overlapping stretches of a power of two."""
    out = np.empty(len(start))
    level = np.frexp((end - start).astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            table = pick(table[: len(table) - (1 << (k - 1))], table[1 << (k - 1) :])
        at = np.flatnonzero(level == k)
        out[at] = pick(table[start[at]], table[end[at] - (1 << k)])
    return out


def upper_parts(values: np.ndarray, start: np.ndarray, end: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`upper_part` of each stretch by a wavelet matrix over the ranks of the sizes, from the highest bit down.

    At each bit the elements are parted stably; a stretch stays one on both sides. Where the wanted rank lies among the zeros, the
    stretch of ones holds larger sizes only, and its sums are taken whole.
    """
    sizes, ranks = np.unique(np.abs(values), return_inverse=True)
    n = end - start
    rank = np.minimum(np.floor(n * share).astype(np.int64), n - 1)
    net, both, order = np.zeros(len(n)), np.zeros(len(n)), np.arange(len(values))
    lo, hi = start, end
    for bit in reversed(range(max(1, int(len(sizes) - 1).bit_length()))):
        ones = (ranks[order] >> bit) & 1
        zeros = prefix(1 - ones)
        order = np.concatenate([order[ones == 0], order[ones == 1]])
        left, right = zeros[lo], zeros[hi]
        up = rank >= right - left
        over_lo, over_hi = zeros[-1] + lo - left, zeros[-1] + hi - right
        below = np.flatnonzero(~up)
        signed, plain = Sums(values[order]), Sums(np.abs(values[order]))
        net[below] += signed.of(over_lo[below], over_hi[below])
        both[below] += plain.of(over_lo[below], over_hi[below])
        rank = np.where(up, rank - (right - left), rank)
        lo, hi = np.where(up, over_lo, left), np.where(up, over_hi, right)
    return sizes[ranks[order[lo]]], net + Sums(values[order]).of(lo, hi), both + Sums(np.abs(values[order])).of(lo, hi)


def stepped(kind: str, values: np.ndarray, missing: np.ndarray, seen: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """`moves` of each stretch. The first row that counts has its predecessor outside."""
    at = np.flatnonzero(seen)
    with np.errstate(invalid="ignore"):
        by = np.diff(values[at])
    hit = by < 0 if kind == "downs" else (by > 0) | np.isnan(by)  # NaN is above all, as in Spark
    flags = np.zeros(len(values), np.int64)
    flags[at[1:]] = hit & ~(missing[at[1:]] | missing[at[:-1]])
    running, first = prefix(flags), np.append(at, len(values))[np.searchsorted(at, start)]
    return np.where(first < end, running[end] - running[np.minimum(first + 1, len(values))], 0)


def measured(m: Measure, values: np.ndarray, missing: np.ndarray, start: np.ndarray, end: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray | None]:
    """Values of a measure and where they are NULL."""
    if m.kind == "upper":
        key = (id(values), m.width, m.share)
        if key not in cache:
            cache[key] = upper_parts(values, start, end, m.share)
        return cache[key][m.part], None
    known = prefix((~missing).astype(np.int64))
    count = known[end] - known[start]
    if m.kind == "rows":
        return count, None
    none = count == 0
    if m.kind == "total":
        return Sums(np.where(missing, 0.0, values)).of(start, end), none
    if m.kind == "least":
        return extremes(np.where(missing, np.inf, values), start, end, np.minimum), none
    if m.kind == "greatest":
        return extremes(np.where(missing, -np.inf, values), start, end, np.maximum), none
    if m.kind == "earliest":
        at = np.where(missing, len(values), np.arange(len(values)))
        following = np.append(np.minimum.accumulate(at[::-1])[::-1], len(values))
        return np.append(values, np.nan)[np.where(none, len(values), following[start])], none
    # n sum(d^2) - sum(d)^2 in whole units, as Python integers: equal values have no deviation at all
    off = np.empty(len(values), object)
    off[:] = [int(x) for x in np.rint(np.where(missing | ~np.isfinite(values), 0.0, values) * SPREAD_UNIT)]
    first, second = prefix(off), prefix(off * off)
    s1, s2 = first[end] - first[start], second[end] - second[start]
    n = np.maximum(count, 1)
    return np.sqrt((n.astype(object) * s2 - s1 * s1).astype(np.float64)) / n / SPREAD_UNIT, none


def _worker(keys: list[str], ts: str, lookback: int, width: int, measures: list[tuple[str, Measure, str]], kept: list[str]):
    span = width + 2 * lookback + 1

    def opening(batch: pa.RecordBatch) -> np.ndarray:
        """Whether each row opens a group; the first one does."""
        n = batch.num_rows
        out = np.zeros(n, bool)
        out[0] = True
        for name in [*keys, CHUNK]:
            a, b = batch.column(name).slice(1), batch.column(name).slice(0, n - 1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
            out[1:] |= ~same.to_numpy(zero_copy_only=False)
        return out

    def times(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(ts).to_numpy(zero_copy_only=False).astype(np.int64)

    def work(batch: pa.RecordBatch, done: int | None = None, until: int | None = None) -> pa.RecordBatch:
        """The rows of the batch that are not halo, those of its first group from after `done`, all before `until`."""
        group = np.cumsum(opening(batch)) - 1
        t = times(batch)
        chunk = batch.column(CHUNK).to_numpy(zero_copy_only=False).astype(np.int64)
        place = group * span + (t - chunk * width + lookback)
        wanted = ~batch.column(HALO).to_numpy(zero_copy_only=False).astype(bool)
        if done is not None:
            wanted &= (group > 0) | (t > done)
        if until is not None:
            wanted &= t < until
        own = np.flatnonzero(wanted)
        end = np.searchsorted(place, place[own], "right")
        starts: dict[int, np.ndarray] = {}
        inputs: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        columns, cache = [], {}
        for _, m, source in measures:
            for name in (source, m.among):
                if name is not None and name not in inputs:
                    column = batch.column(name)
                    missing = column.is_null().to_numpy(zero_copy_only=False)
                    inputs[name] = np.where(missing, np.nan, column.to_numpy(zero_copy_only=False).astype(np.float64)), missing
            w = m.width if m.width is not None else lookback
            if w not in starts:
                starts[w] = np.searchsorted(place, place[own] - w, "left")
            if m.among is None:
                found, none = measured(m, *inputs[source], starts[w], end, cache)
            else:
                found, none = stepped(m.kind, *inputs[source], ~inputs[m.among][1], starts[w], end), None
            kind = pa.int64() if _TYPES[m.kind] == "long" else pa.float64()
            columns.append(pa.array(found, kind, mask=none))
        whole = batch.take(pa.array(own))
        return pa.record_batch([*[whole.column(c) for c in kept], *columns], names=[*kept, *[n for n, _, _ in measures]])

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one group: what is not done, and what its frames reach back to
        last, done, size, most = None, None, 0, BLOCK
        for batch in batches:
            if not batch.num_rows:
                continue
            opens = opening(batch)
            first = tuple(batch.column(k)[0].as_py() for k in [*keys, CHUNK])
            opens[0] = first != last
            last = tuple(batch.column(k)[-1].as_py() for k in [*keys, CHUNK])
            at = np.flatnonzero(opens)
            if len(at) and (held or at[-1]):
                cut = int(at[-1])
                # a group that was begun is the first of what is held
                yield work(joined([*held, batch.slice(0, cut)] if cut else held), done)
                held, done, most = [batch.slice(cut)], None, BLOCK
                size = batch.num_rows - cut
            else:
                held.append(batch)
                size += batch.num_rows
            if size >= most:
                block = joined(held)
                t = times(block)
                yield work(block, done, int(t[-1]))
                rest = int(np.searchsorted(t, t[-1] - lookback, "left"))
                # copied, so that the rows before it are let go
                held, done, size = [block.take(pa.array(np.arange(rest, len(t))))], int(t[-1]) - 1, len(t) - rest
                most = max(BLOCK, 2 * size)
        if held:
            yield work(joined(held), done)

    return run


def _sums(df: DataFrame, keys: list[str], ts: str, lookback: int, chunk_width: int, measures: dict[str, Measure]) -> DataFrame:
    """Totals and counts as differences of running sums, all windows on one shuffle.

    Running sums in whole units and 1e-8 are exact integers. Each row also sends a probe to the instant before its frame begins; one
    forward fill over rows and probes gives the running sums there.
    """
    whole, count = "long", F.lit(0).cast("long")
    widths = {name: lookback if m.width is None else m.width for name, m in measures.items()}
    columns: dict[str, Column] = {}
    sources: dict[str, int] = {}
    read: dict[str, list[str]] = {}
    for name, m in measures.items():
        i = sources.setdefault(str(m.value), len(sources))
        value = m.value.cast("double")
        columns[f"_n{i}"] = F.when(value.isNotNull(), F.lit(1).cast("long")).otherwise(count)
        read[name] = [f"_n{i}"]
        if m.kind == "total":
            finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
            floor = F.floor(value).cast(whole)
            columns[f"_h{i}"] = F.when(finite, floor).otherwise(count)
            columns[f"_l{i}"] = F.when(finite, F.round((value - floor) * UNIT).cast(whole)).otherwise(count)
            columns[f"_b{i}"] = F.when(value.isNotNull() & ~finite, F.lit(1).cast("long")).otherwise(count)
            read[name] += [f"_h{i}", f"_l{i}", f"_b{i}"]
    running = Window.partitionBy(*keys, CHUNK).orderBy(ts).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # a given number of parts is not merged again: what is small in a shuffle is large in the sorts of these windows
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_halo(df.withColumns(columns), ts, lookback, chunk_width).repartition(parts, *keys, CHUNK)
    rows = rows.withColumns({c: F.sum(c).over(running) for c in columns})
    kept = [c for c in df.columns if c not in measures]
    filling = Window.partitionBy(*keys, CHUNK).orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def inside(c: str) -> Column:
        return F.col(c) - F.coalesce(F.col(f"_before.{c}"), count)

    # a width is finished before the next, which then sorts its results only and what is still to be read
    out = {name: f"_o{i}" for i, name in enumerate(measures)}
    for width in sorted(set(widths.values())):
        own = F.struct(F.lit(False).alias("_probe"), F.col(ts).cast("long").alias("_at"))
        probe = F.struct(F.lit(True).alias("_probe"), (F.col(ts).cast("long") - width - 1).alias("_at"))
        entries = F.when(F.col(HALO), F.array(own)).otherwise(F.array(own, probe))
        rows = rows.withColumn("_e", F.explode(entries)).select("*", "_e.*").drop("_e")
        needed = sorted({c for name in measures if widths[name] == width for c in read[name]})
        later = {c for name in measures if widths[name] > width for c in read[name]}
        seen = F.last(F.when(~F.col("_probe"), F.struct(*needed)), ignorenulls=True).over(filling)
        rows = rows.withColumn("_before", seen).where(F.col("_probe") | F.col(HALO))
        done = {}
        for name, m in measures.items():
            if widths[name] != width:
                continue
            n, *sums = read[name]
            if m.kind == "rows":
                done[out[name]] = inside(n)
            else:
                high, low, bad = sums
                value = inside(high).cast("double") + inside(low) / UNIT
                done[out[name]] = F.when(inside(n) > 0, F.when(inside(bad) > 0, F.lit(float("nan"))).otherwise(value))
        rows = rows.withColumns(done).drop("_probe", "_at", "_before", *[c for c in columns if c not in later])
    return rows.where(~F.col(HALO)).select(*kept, *[F.col(c).alias(name) for name, c in out.items()])


def sliding(
    df: DataFrame, keys: list[str], ts: str, lookback: int, chunk_width: int, order: list[str] | None = None, only: Column | None = None,
    keep: list[str] | None = None, **measures: Measure,
) -> DataFrame:
    """Rows of `df` with one column per measure over the rows of their key in [ts - width, ts], rows of the same ts included.

    No measure may be wider than `lookback`. `order` settles which of the rows with one ts is first. Rows without ts are left out.
    Totals and counts alone stay in the JVM, so only the columns that are read later are read at all. With `only`, the
    other rows are in the frames but get no result; with `keep`, these columns of `df` come back and not all.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in measures]
    if all(m.kind in ("total", "rows") for m in measures.values()):
        out = _sums(df, keys, ts, lookback, chunk_width, measures)
        return (out if only is None else out.where(only)).select(*kept, *measures)
    from pyspark.sql.types import StructType

    sources: dict[str, str] = {}
    columns: dict[str, Column] = {}
    named = []
    for name, m in measures.items():
        of = [None, None]
        for i, column in enumerate((m.value, m.among)):
            if column is not None:
                of[i] = sources.setdefault(str(column), f"_in{len(sources)}")
                columns[of[i]] = column.cast("double")
        named.append((name, Measure(m.kind, None, m.width, m.share, m.part, of[1]), of[0]))
    dealt = with_halo(df, ts, lookback, chunk_width)
    if only is not None:
        dealt = dealt.withColumn(HALO, F.col(HALO) | ~F.coalesce(only, F.lit(False)))
    dealt = dealt.repartition(*[F.col(c) for c in [*keys, CHUNK]]).sortWithinPartitions(*keys, CHUNK, ts, *(order or []))
    # what the worker reads is computed behind the shuffle and the sort, which then carry the columns it comes from
    dealt = dealt.select(*dict.fromkeys([*keys, ts, *kept]), CHUNK, HALO, *[c.alias(name) for name, c in columns.items()])
    out = StructType.fromDDL(", ".join(f"`{n}` {_TYPES[m.kind]}" for n, m, _ in named))
    shape = StructType([*[df.schema[c] for c in kept], *out.fields])
    return dealt.mapInArrow(_worker(list(keys), ts, lookback, chunk_width, named, kept), shape)


ship_by_value(__name__)
