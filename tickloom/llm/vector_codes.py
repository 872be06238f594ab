"""Vectors as product codes: k-means per part with norm-of-sum bounds.

Each part of a vector keeps an upper bound, its distance to its entry, and a lower bound for each group of entries,
its distance to the nearest other entry there. A bound is stored as it was computed, together with a stamp of the
round. The codebooks of all rounds are kept, so what a bound has to allow for later is the true displacement of an entry
between the two rounds, the norm of the sum of its moves, never more than the sum of their norms. Groups whose
lower bound still exceeds the upper one cannot hold the nearest entry and are not looked at; the others are scanned
exactly in integers.

Spark holds the state of the rows, one table a round. Only parts that moved send their components to the sums of the entries;
the driver gets these sums, a number for each component of the codebooks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import stored
from tickloom.session import ship_by_value

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
GROUPS = 4
SLACK = 1e-6
HEAVY = 64
NONE = 255


def state_type(parts: int, groups: int) -> np.dtype:
    return np.dtype([
        ("code", "u1", parts), ("was", "u1", parts), ("at", "u1", parts), ("seen", "u1", (parts, groups)), ("scans", "i4"),
        ("upper", "f8", parts), ("lower", "f4", (parts, groups)),
    ])


def halves(entries: np.ndarray, members: np.ndarray, count: int) -> list[np.ndarray]:
    """Groups of near entries: halved along the widest component."""
    if count == 1 or len(members) < 2:
        return [np.sort(members)]
    x = entries[members]
    order = members[np.argsort(x[:, np.ptp(x, axis=0).argmax()], kind="stable")]
    cut = len(order) // 2
    return halves(entries, order[:cut], count // 2) + halves(entries, order[cut:], count // 2)


def squared(v: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer entries: as floating products while these are exact."""
    top = float(max(np.abs(v).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * v.shape[1] * top**2 < 2**53:
        a, b = v.astype(np.float64), entries.astype(np.float64)
        return ((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(v), len(entries)), np.int64)
    for at in range(0, len(v), 256):
        out[at : at + 256] = ((v[at : at + 256, None, :] - entries[None]) ** 2).sum(2)
    return out


def displacement(then: np.ndarray, now: np.ndarray) -> np.ndarray:
    """How far each entry is from where it was: the norm of the sum of its moves."""
    return np.linalg.norm((now - then).astype(np.float64), axis=-1)


def assign_part(v, state, p: int, history: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """Assign one part of some rows to the newest codebook, in place; exact squared distances where known, else -1."""
    now = len(history) - 1
    entries = history[now]
    moved = np.stack([displacement(then, entries) for then in history])
    drift = np.stack([moved[:, g].max(1) for g in groups], axis=1)
    code, rows = state["code"][:, p].astype(np.int64), np.arange(len(v))
    known = np.full(len(v), -1, np.int64)
    lower = state["lower"][:, p] - drift[state["seen"][:, p], np.arange(len(groups))] * (1 + SLACK)
    upper = state["upper"][:, p] + moved[state["at"][:, p], code] * (1 + SLACK)
    todo = np.flatnonzero((lower <= upper[:, None]).any(1))
    if len(todo):  # an upper bound is made tight before anything is scanned
        known[todo] = ((v[todo] - entries[code[todo]]) ** 2).sum(1)
        state["upper"][todo, p], state["at"][todo, p] = np.sqrt(known[todo]) * (1 + SLACK), now
        upper[todo] = state["upper"][todo, p]
    scan = lower <= upper[:, None]
    todo = np.flatnonzero(scan.any(1))
    if not len(todo):
        return known
    own = np.empty(len(entries), np.int64)
    for g, members in enumerate(groups):
        own[members] = g
    scan[todo, own[code[todo]]] = True  # where the entry may change, the bound of its group does
    best, entry = known[todo], code[todo]
    slot = np.full(len(v), -1, np.int64)
    slot[todo] = np.arange(len(todo))
    near = {}
    for g, members in enumerate(groups):
        some = rows[scan[:, g]]
        if not len(some):
            continue
        d = squared(v[some], entries[members])
        first = d.argmin(1)
        low = d[np.arange(len(some)), first]
        second = np.partition(d, 1, axis=1)[:, 1] if len(members) > 1 else np.full(len(some), np.iinfo(np.int64).max)
        near[g] = some, low, second, members[first]
        at = slot[some]
        better = (low < best[at]) | ((low == best[at]) & (members[first] < entry[at]))
        best[at[better]], entry[at[better]] = low[better], members[first[better]]
        state["scans"][some] += 1
    for g, (some, low, second, first) in near.items():
        other = np.where(entry[slot[some]] == first, second, low)
        state["lower"][some, p, g] = np.sqrt(other.astype(np.float64)) * (1 - SLACK)
        state["seen"][some, p, g] = now
    state["code"][todo, p], known[todo] = entry, best
    state["upper"][todo, p], state["at"][todo, p] = np.sqrt(best) * (1 + SLACK), now
    return known


def assigner(history, groups: list[list[np.ndarray]], kind: np.dtype, last: bool):
    """Rows with the state after this round; after the last one with code and error instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = history.value
        parts, width = books.shape[1], books.shape[3]
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts, width)
            if "state" in batch.schema.names:
                state = np.frombuffer(b"".join(batch.column("state").to_pylist()), kind).copy()
                state["was"] = state["code"]
            else:
                state = np.zeros(n, kind)
                state["upper"], state["lower"], state["was"] = np.inf, -np.inf, NONE
            first = "state" not in batch.schema.names
            error = np.zeros(n, np.int64)
            for p in range(parts):
                known = assign_part(v[:, p], state, p, books[:, p], groups[p])
                if last:
                    rest = np.flatnonzero(known < 0)
                    known[rest] = ((v[rest, p] - books[-1, p][state["code"][rest, p]]) ** 2).sum(1)
                    error += known
            if last:
                codes = [c.tobytes().hex() for c in np.ascontiguousarray(state["code"])]
                columns = {"code": pa.array(codes, pa.string()), "error": pa.array(error), "scans": pa.array(state["scans"])}
            else:
                moved = np.ones(n, bool) if first else (state["code"] != state["was"]).any(1)
                columns = {"v": batch.column("v"), "state": pa.array([s.tobytes() for s in state], pa.binary()), "moved": pa.array(moved)}
            columns = {"id": batch.column("id"), "label": batch.column("label")} | columns
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


def move_sums(shape: tuple, kind: np.dtype, first: bool):
    """What the moved parts of a task add to and take from the sums of the entries: (slot, total), one row a changed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = shape
        totals = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts, width)
            state = np.frombuffer(b"".join(batch.column("state").to_pylist()), kind)
            for p in range(parts):
                moved = np.flatnonzero((state["code"][:, p] != state["was"][:, p]) | first)
                ones = np.concatenate([v[moved, p], np.ones((len(moved), 1), np.int64)], axis=1)
                np.add.at(totals[p], state["code"][moved, p], ones)
                if not first:
                    np.subtract.at(totals[p], state["was"][moved, p], ones)
        flat = totals.reshape(-1)
        slot = np.flatnonzero(flat)
        yield pa.record_batch([pa.array(slot), pa.array(flat[slot])], names=["slot", "total"])

    return run


def with_label_errors(rows: DataFrame) -> DataFrame:
    """Add the sum of the errors of each label. A label with more than 1/64 of the rows is one of at most 64 and is broadcast."""
    sums = stored(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    heavy = F.col("n") * HEAVY > rows.count()
    seen = rows.join(F.broadcast(sums.where(heavy).drop("n")), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    rest = seen.where(F.col("label_error").isNull()).drop("label_error")
    rest = rest.join(sums.where(~heavy).drop("n"), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return seen.where(F.col("label_error").isNotNull()).unionByName(rest)


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, code, error, label, label_error, scans) and the final codebooks as an array (part, entry, position).

    Vectors that are null, empty or hold null or non-finite components are left out. The others need one length, a
    multiple of `parts`, and components so small that every error fits a long; else ValueError. The first entries are the
    vectors with the smallest ids (nulls last; of one id the smaller vector first), so repeated rows are entries
    twice and the lower index takes all; fewer rows than `entries` make fewer entries. Ties go to the lower index.
    scans counts the groups of entries that were scanned for a row. No rows give no rows and empty codebooks.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.where(x.isNotNull() & (F.size(x) > 0) & finite)
    cells = F.transform(x, lambda c: F.floor(c * scale))
    kept = kept.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), cells.alias("v"))
    found = kept.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("top")).first()
    if found["low"] is None:
        empty = f"id long, code string, error long, label {kept.schema['label'].dataType.simpleString()}, label_error long, scans int"
        return spark.createDataFrame([], empty), np.zeros((parts, 0, 0), np.int64)
    if found["low"] != found["high"] or found["low"] % parts:
        raise ValueError(f"vectors of {found['low']} to {found['high']} components cannot be cut into {parts} equal parts")
    if 4 * found["low"] * found["top"] ** 2 >= 2**63:
        raise ValueError("components are too large for errors in a long")
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    book = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    groups = [halves(book[p], np.arange(len(first)), GROUPS) for p in range(parts)]
    kind = state_type(parts, max(map(len, groups)))
    shape = book.shape
    history, totals = [book], np.zeros((shape[0], shape[1], shape[2] + 1), np.int64)
    label = kept.schema["label"].dataType.simpleString()
    rows = kept.select("id", "label", F.col("v").cast("array<int>").alias("v"))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(np.stack(history))
        rows = rows.mapInArrow(assigner(shared, groups, kind, False), f"id long, label {label}, v array<int>, state binary, moved boolean")
        rows = stored(rows, "code-round")
        moves = rows.where("moved").select("v", "state").mapInArrow(move_sums(shape, kind, r == 0), "slot long, total long")
        moves = moves.groupBy("slot").agg(F.sum("total").alias("total")).toPandas()
        totals.reshape(-1)[moves["slot"].to_numpy()] += moves["total"].to_numpy()
        used = totals[:, :, -1] > 0
        book = book.copy()
        book[used] = totals[used][:, :-1] // totals[used][:, -1:]
        history.append(book)
        rows = rows.drop("moved")
    shared = spark.sparkContext.broadcast(np.stack(history))
    coded = rows.mapInArrow(assigner(shared, groups, kind, True), f"id long, label {label}, code string, error long, scans int")
    return with_label_errors(stored(coded, "codes")), book


def fingerprint(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
    return sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def decoded(code: str, codebooks: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([codebooks[p][e] for p, e in enumerate(bytes.fromhex(code))]) / scale


ship_by_value(__name__)
