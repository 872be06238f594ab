"""Ordered computations that do not put a whole key into one task.

A plain window over (exchange, symbol) sends every row of that key to one task, and
one hot key can hold a third of the data. The helpers here partition by the key *and*
a chunk of the order column, and restore what a row needs from outside its chunk:

* `scan`      running totals, forward fills, previous / next row: the chunk summaries
              (one row per key and chunk, built by partial aggregation) are accumulated
              over chunks and joined back as a carry;
* `with_halo` bounded range frames: rows near the end of a chunk are also sent to the
              chunks whose frames can still see them;
* `asof`      latest right row at or before each left row: union plus forward fill;
* `order_statistics` exact ranks per group through counted values;
* `interval_join`    point-in-interval join on an equi-key of (key, bucket).

A chunk is a plain column that never decreases along the order, usually `chunk_of(ts, width)`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
HALO = "_halo"


def chunk_of(column: str, width: int) -> Column:
    return F.floor(F.col(column) / F.lit(width))


def choose_chunk_width(df: DataFrame, keys: list[str], column: str, widths: list[int], max_rows: int) -> int:
    """The widest of `widths` under which no (key, chunk) holds more than max_rows rows.

    Chunks are fixed intervals, so a burst can crowd one of them; run this on new data before
    settling on a width. One aggregation per width, one number comes back. If even the narrowest
    is too crowded it is returned.
    """
    for width in sorted(widths, reverse=True):
        sizes = df.groupBy(*keys, chunk_of(column, width).alias(CHUNK)).agg(F.count(F.lit(1)).alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= max_rows:
            return width
    return min(widths)


@dataclass(frozen=True)
class Run:
    kind: str
    value: Column
    frame: str = "rows"
    reverse: bool = False


def cumsum(value: Column, frame: str = "rows") -> Run:
    return Run("sum", value, frame)


def cummax(value: Column, frame: str = "rows") -> Run:
    return Run("max", value, frame)


def cummin(value: Column, frame: str = "rows", reverse: bool = False) -> Run:
    return Run("min", value, frame, reverse)


def ffill(value: Column, frame: str = "rows") -> Run:
    return Run("last", value, frame)


def prev(value: Column) -> Run:
    return Run("prev", value)


def following(value: Column) -> Run:
    return Run("prev", value, reverse=True)


_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def _frame(window, frame: str):
    start = Window.unboundedPreceding
    if frame == "rows":
        return window.rowsBetween(start, Window.currentRow)
    if frame == "rows_before":
        return window.rowsBetween(start, -1)
    if frame == "range":
        return window.rangeBetween(start, Window.currentRow)
    if frame == "range_before":
        return window.rangeBetween(start, -1)
    raise ValueError(frame)


def _last(column: Column) -> Column:
    return F.last(column, ignorenulls=True)


_STAND_IN = {"string": "\u0000", "bigint": -(2**63), "int": -(2**31), "date": "0001-01-01"}


def _never_null(column: Column, kind: str) -> Column:
    if kind in _STAND_IN:
        return F.coalesce(column, F.lit(_STAND_IN[kind]).cast(kind))
    return F.struct(column.alias("v"))


def _slot(df: DataFrame, keys: list[str]) -> dict[str, Column]:
    """Partition columns for `keys` that are never NULL, so that a NULL key is a group like any other
    and no filter is inferred for one side of the carry join only."""
    kinds = {k: df.schema[k].dataType.simpleString() for k in keys}
    return {f"_k{i}": _never_null(F.col(k), kinds[k]) for i, k in enumerate(keys)}


def _readable(df: DataFrame) -> list[Column]:
    """Every column in a form `hash` accepts."""
    odd = ("map<", "variant")
    return [
        F.to_json(F.struct(f.name)) if any(t in f.dataType.simpleString() for t in odd) else F.col(f.name) for f in df.schema
    ]


def scan(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, keep_chunk: bool = False, **runs: Run
) -> DataFrame:
    """Add one column per run, computed along `order` within `keys`.

    The rows are shuffled once, on (keys, chunk); the windows and the chunk summaries both read
    that shuffle. The order inside a key must be total unless a `range` frame is used. Inclusive
    by default; frames ending in `_before` exclude the current row (or its peers).
    A following scan of the same keys stays on the shuffle when the chunk is kept and passed on
    as `F.col(CHUNK)`.
    """
    slots = _slot(df, keys)
    names = [*slots, CHUNK]
    kind = df.select(chunk.alias("c")).schema["c"].dataType.simpleString()
    base = df.withColumns({**slots, CHUNK: _never_null(chunk, kind)}).repartition(*[F.col(n) for n in names])
    # one primitive order column keeps the summary a hash aggregation
    position = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    local, totals, carried, final = {}, [], [], {}
    for name, run in runs.items():
        direction = [F.col(c).desc() if run.reverse else F.col(c).asc() for c in order]
        inner = Window.partitionBy(*names).orderBy(*direction)
        outer_order = F.col(CHUNK).desc() if run.reverse else F.col(CHUNK).asc()
        outer = _frame(Window.partitionBy(*slots).orderBy(outer_order), "rows_before")
        near, far = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        pick = F.min_by if run.reverse else F.max_by
        if run.kind == "prev":
            local[f"_l_{name}"] = F.lag(run.value).over(inner)
            local[f"_has{int(run.reverse)}"] = F.lag(F.lit(True)).over(inner)
            totals.append(pick(run.value, position).alias(name))
            carried.append(F.lag(name).over(Window.partitionBy(*slots).orderBy(outer_order)).alias(f"_c_{name}"))
            final[name] = F.when(F.col(f"_has{int(run.reverse)}"), near).otherwise(far)
        elif run.kind == "last":
            local[f"_l_{name}"] = _last(run.value).over(_frame(inner, run.frame))
            totals.append(pick(run.value, F.when(run.value.isNotNull(), position)).alias(name))
            carried.append(_last(F.col(name)).over(outer).alias(f"_c_{name}"))
            final[name] = F.coalesce(near, far)
        else:
            fold = _FOLD[run.kind]
            local[f"_l_{name}"] = fold(run.value).over(_frame(inner, run.frame))
            totals.append(fold(run.value).alias(name))
            carried.append(fold(F.col(name)).over(outer).alias(f"_c_{name}"))
            if run.kind == "sum":
                final[name] = F.when(
                    near.isNotNull() | far.isNotNull(), F.coalesce(far, F.lit(0)) + F.coalesce(near, F.lit(0))
                )
            else:
                final[name] = (F.greatest if run.kind == "max" else F.least)(near, far)
    # The hash reads every column on both sides, so whatever is read later column pruning leaves both readers the same
    # shuffle and Spark runs it (and all that feeds it) once. The conditions themselves always hold.
    whole, floor = F.hash(*_readable(base)), F.lit(-(2**31))
    summary = base.groupBy(*names).agg(*totals, F.max(whole).alias("_all")).filter(F.col("_all") >= floor)
    summary = summary.select(*names, *carried)
    kept = [c for c in df.columns if c not in runs and c != CHUNK] + ([CHUNK] if keep_chunk else [])
    joined = base.withColumns(local).filter(whole >= floor).join(summary, names, "left")
    return joined.select(*kept, *[final[n].alias(n) for n in runs])


def with_halo(df: DataFrame, ts: str, lookback: int, chunk_width: int) -> DataFrame:
    """Copy each row to the later chunks whose frames of length `lookback` reach back to it.

    Follow with windows over `frame_window(...)` and `drop_halo`. With chunks several times
    the lookback only the rows of the last `lookback` of a chunk are sent twice.
    """
    own = chunk_of(ts, chunk_width)
    reach = F.floor((F.col(ts) + F.lit(lookback)) / F.lit(chunk_width))
    return (
        df.withColumn("_own", own)
        .withColumn(CHUNK, F.explode(F.sequence(F.col("_own"), reach)))
        .withColumn(HALO, F.col(CHUNK) != F.col("_own"))
        .drop("_own")
    )


def frame_window(keys: list[str], ts: str, lookback: int):
    return Window.partitionBy(*keys, CHUNK).orderBy(ts).rangeBetween(-lookback, 0)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(CHUNK, HALO)


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    values: list[str],
    chunk_width: int,
    right_tie: str | None = None,
) -> DataFrame:
    """Each left row with `values` of the latest right row of its key, right_ts <= left_ts.

    Columns of the match arrive as one struct `matched` (NULL where none exists).
    """
    payload = F.struct(*[F.col(v) for v in values])
    tie = F.col(right_tie).cast("long") if right_tie else F.lit(0).cast("long")
    side = right.select(
        *keys, F.col(right_ts).cast("long").alias("_at"), F.lit(0).alias("_tag"), tie.alias("_tie"),
        payload.alias("_value"),
    )
    probe = left.select(
        *keys, F.col(left_ts).cast("long").alias("_at"), F.lit(1).alias("_tag"), F.lit(0).cast("long").alias("_tie"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_row"),
    )
    merged = side.unionByName(probe, allowMissingColumns=True)
    filled = scan(
        merged, keys, ["_at", "_tag", "_tie"], chunk_of("_at", chunk_width), matched=ffill(F.col("_value"))
    )
    return filled.filter(F.col("_tag") == 1).select("_row.*", "matched")


def order_statistics(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], value_chunk: Column
) -> DataFrame:
    """Exact order statistics per group, without sorting a group in one task.

    `ranks` maps an output name to a zero-based rank written over the column `n` (the group
    size). Values are counted first, so a hot value is one row before any window runs.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt"))
    sizes = counted.groupBy(*keys).agg(F.sum("_cnt").alias("n"))
    running = scan(counted, keys, [value], value_chunk, _hi=cumsum(F.col("_cnt")))
    ranked = running.join(sizes, keys) if keys else running.withColumn("n", sizes.scalar())
    lo, hi = F.col("_hi") - F.col("_cnt"), F.col("_hi")
    picks = [
        F.max(F.when((rank >= lo) & (rank < hi), F.col(value))).alias(name) for name, rank in ranks.items()
    ]
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, stop: str, width: int,
    how: str = "inner",
) -> DataFrame:
    """Points joined to the half-open intervals [start, stop) of their key that contain them.

    With `how="left"` a point outside every interval keeps one row, without interval.

    Both sides carry a bucket of the axis, so Spark runs an equi-join on (keys, bucket) with
    the range as a residual; the output stays partitioned by (keys, bucket).
    """
    spread = intervals.withColumn(
        "_bucket",
        F.explode(
            F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - F.lit(1)) / width))
        ),
    )
    located = points.withColumn("_bucket", F.floor(F.col(at) / width))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))
    if how == "inner":
        return located.join(spread, [*keys, "_bucket"]).filter(inside)
    other = spread.withColumnsRenamed({k: f"_of_{k}" for k in (*keys, "_bucket")})
    for k in (*keys, "_bucket"):
        inside = inside & (F.col(k) == F.col(f"_of_{k}"))
    return located.join(other, inside, how).drop(*[f"_of_{k}" for k in (*keys, "_bucket")])
