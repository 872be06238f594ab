"""Ladders that forget: a side of a book that keeps its best levels only, replayed in parallel.

What such a side holds depends on its whole path since the snapshot, as a level once pushed out stays out. Yet mostly it
holds the best levels of the full book. So a span between snapshots is cut into segments, and each is replayed from a guess: the best
levels of the full ladder where it begins. A segment is right if the one before it is and ends in what was guessed. Where the
guess was wrong, because a level had been forgotten, the segment is replayed from that end, and this may go on from segment to
segment; after some rounds what is still open of a span is replayed in one piece, in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.replay import KEY, chunk_marks, ladder_checkpoints, same_key
from tickloom.plans.ordered import CHUNK, chunk_of
from tickloom.session import ship_by_value, stored

SPAN = [*KEY, "side", "epoch"]
SEGMENT = [*SPAN, "segment"]
READ = [*SPAN, "seq", "is_snapshot", "price_ticks", "price", "quantity"]
_KEYS = "exchange string, symbol string, side string, epoch long, segment long"
_HELD = "array<struct<ticks:long,quantity:double>>"
_OUT = f"{_KEYS}, seq long, levels long, best_ticks long, quantity double, held {_HELD}"


def _walker(depth: int):
    """Side summaries after each message, and one row without seq that says what a segment ends with."""
    held_type = pa.list_(pa.struct([("ticks", pa.int64()), ("quantity", pa.float64())]))
    kinds = [pa.string()] * 3 + [pa.int64()] * 5 + [pa.float64(), held_type]
    names = [f.split()[0] for f in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, message, held, out = None, None, {}, []

        def best() -> int | None:
            return (max(held) if here[2] == "bid" else min(held)) if held else None

        def said() -> None:
            out.append((*here, message, len(held), best(), float(sum(held.values())), None))

        def ended() -> None:
            out.append((*here, None, None, None, None, [{"ticks": t, "quantity": held[t]} for t in sorted(held)]))

        for batch in batches:
            for *segment, entry, seq, ticks, quantity in zip(*[c.to_pylist() for c in batch.columns]):
                if segment != here or seq != message:
                    if message is not None:
                        said()
                    if segment != here:
                        if here is not None:
                            ended()
                        here, held = segment, {}
                    message = seq
                if entry is not None:
                    held = {e["ticks"]: e["quantity"] for e in entry}
                    message = None
                elif quantity == 0:
                    held.pop(ticks, None)
                else:
                    held[ticks] = quantity
                    if len(held) > depth:
                        held.pop(min(held) if here[2] == "bid" else max(held))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if here is not None:
            if message is not None:
                said()
            ended()
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def _stored(df: DataFrame) -> DataFrame:
    return stored(df, "ladders")


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Rows of a with the other columns of b, keys compared with NULL as a value."""
    out = a.alias("a").join(b.alias("b"), same_key("a", "b", keys), how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.select("a.*", *[F.col(f"b.{c}") for c in b.columns if c not in keys])


def _replayed(rows: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """The given segments from the given entries; rows and entries carry SEGMENT."""
    first = entries.select(*SEGMENT, F.coalesce("entry", F.array().cast(_HELD)).alias("entry"))
    both = first.unionByName(_joined(rows, entries.select(*SEGMENT), SEGMENT, "left_semi"), allowMissingColumns=True)
    both = both.select(*SEGMENT, "entry", "seq", "price_ticks", "quantity")
    ordered = both.repartition(*[F.col(c) for c in SEGMENT]).sortWithinPartitions(*SEGMENT, F.col("entry").isNull(), "seq", "price_ticks")
    return ordered.mapInArrow(_walker(depth), _OUT)


def truncated(levels: DataFrame, chunk: int, depth: int, rounds: int = 4) -> DataFrame:
    """Summary of each side after each message that touches it; levels carry epoch, the snapshot in force.

    The result is the same for any chunk and any number of rounds. Levels are stored first: segments, guesses and every round read them.
    """
    levels = _stored(levels.select(*[c for c in levels.columns if c in READ]))
    rows = levels.withColumn("segment", chunk_of("seq", chunk).cast("long"))
    thin = rows.select(*SEGMENT, "seq", "price_ticks", "quantity")
    along = Window.partitionBy(*SPAN).orderBy("segment")
    segments = _stored(thin.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.lag("segment").over(along)))
    ranked = F.sort_array(F.collect_list(F.struct(F.when(F.col("side") == "bid", -F.col("price_ticks")).otherwise(F.col("price_ticks")).alias("rank"), "price_ticks", "quantity")))
    guess = ladder_checkpoints(levels, chunk, chunk_marks(levels, chunk)).groupBy(*KEY, "side", F.col(CHUNK).cast("long").alias("segment")).agg(
        F.transform(F.slice(ranked, 1, depth), lambda x: F.struct(x["price_ticks"].alias("ticks"), x["quantity"].alias("quantity"))).alias("guess"))
    at = [*KEY, "side", "segment"]
    entries = _joined(segments, guess, at, "left").withColumn(
        "entry", F.when(F.col("before").isNotNull(), F.sort_array("guess"))).select(*SEGMENT, "before", "entry")
    entries = _stored(entries.withColumn("entry", F.coalesce("entry", F.array().cast(_HELD))))
    answers = _stored(_replayed(thin, entries, depth))
    for _ in range(rounds):
        wrong = _wrong(entries, answers)
        if wrong.isEmpty():
            break
        again = _stored(_replayed(thin, wrong, depth))
        answers = _joined(answers, wrong, SEGMENT, "left_anti").unionByName(again)
        entries = _stored(_joined(entries, wrong, SEGMENT, "left_anti").unionByName(wrong))
    else:
        wrong = _wrong(entries, answers)
        if not wrong.isEmpty():  # the rest of those spans in order
            start = _stored(wrong.groupBy(*SPAN).agg(F.min_by(F.struct("segment", "entry"), "segment").alias("s")).select(*SPAN, F.col("s.segment").alias("from"), "s.entry"))
            rest = _joined(thin, start, SPAN, "inner").where(F.col("segment") >= F.col("from"))
            rest = rest.withColumn("segment", F.col("from")).select(*thin.columns)
            again = _replayed(rest, start.withColumnRenamed("from", "segment"), depth)
            kept = _joined(answers, start, SPAN, "left").where(F.col("from").isNull() | (F.col("segment") < F.col("from"))).select(*answers.columns)
            answers = kept.unionByName(again)
    return answers.where(F.col("seq").isNotNull()).select(*SPAN, "seq", "levels", "best_ticks", "quantity")


def _wrong(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """Segments entered with something else than the one before them ended with, and what that was."""
    ends = answers.where(F.col("seq").isNull()).select(*SPAN, F.col("segment").alias("before"), F.col("held").alias("end"))
    found = _joined(entries.where(F.col("before").isNotNull()), ends, [*SPAN, "before"], "inner")
    return _stored(found.where(~F.col("entry").eqNullSafe(F.col("end"))).select(*SEGMENT, "before", F.col("end").alias("entry")))


ship_by_value(__name__)
