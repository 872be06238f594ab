"""Path-dependent results of a key, folded over chunks that are worked on in parallel.

The state after a chunk is a function of the state before it. Where that function has a short description, a fold takes
three passes, each over rows sorted inside partitions and streamed in Arrow batches, so no pass holds more than one batch:

1. every (key, chunk) is described on its own, without knowing where it starts;
2. the descriptions of a key, one small row a chunk, are applied one after another: the entry state of every chunk;
3. every chunk is walked through from its entry state.

A fold says how (`Fold`). States and descriptions are any Python values; they travel pickled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.plans.ordered import CHUNK
from tickloom.session import ship_by_value


class Fold:
    """A fold over rows; the values of a row come in the order of `inputs`."""

    start: Any = None
    outputs: str = ""

    def describe(self) -> Description:
        """A new `Description`, which takes the rows in order."""
        raise NotImplementedError

    def advance(self, state: Any, description: Any) -> Any:
        """The state after a chunk that was entered in `state`."""
        raise NotImplementedError

    def step(self, state: Any, *values) -> tuple[Any, tuple]:
        """The state after a row, and the row's values of `outputs`."""
        raise NotImplementedError

    def steps(self, state: Any, *columns: list) -> tuple[Any, list[list]]:
        """The state after some rows, given as columns, and the columns of `outputs`."""
        found = [[] for _ in self.outputs.split(",")]
        for values in zip(*columns):
            state, out = self.step(state, *values)
            for column, value in zip(found, out):
                column.append(value)
        return state, found


class Description:
    """What a chunk does to an unknown entry state."""

    def add(self, *values) -> None:
        raise NotImplementedError

    def extend(self, *columns: list) -> None:
        for values in zip(*columns):
            self.add(*values)

    def result(self) -> Any:
        raise NotImplementedError


_ENTRY, _TAG = "_entry", "_tag"


def listed(column: pa.Array) -> list:
    """Its Python values; by way of numpy where that gives the same ones faster."""
    kind = column.type
    if column.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def stretches(columns: list[pa.Array]) -> list[tuple[int, int]]:
    """[start, end) of the rows that agree with the row before them in every column, NULL agreeing with NULL."""
    n = len(columns[0])
    opens = np.zeros(n, bool)
    opens[:1] = True
    for column in columns:
        a, b = column.slice(1), column.slice(0, max(n - 1, 0))
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
        opens[1:] |= ~same.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(opens).tolist()
    return list(zip(starts, [*starts[1:], n]))


def _describer(fold: Fold, slots: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, description, out = None, None, []
        for batch in batches:
            columns = [listed(c) for c in batch.columns[slots:]]
            for start, end in stretches(batch.columns[:slots]) if batch.num_rows else ():
                slot = tuple(c[start].as_py() for c in batch.columns[:slots])
                if slot != here:
                    if here is not None:
                        out.append((*here, pickle.dumps(description.result())))
                    here, description = slot, fold.describe()
                description.extend(*[c[start:end] for c in columns])
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if here is not None:
            out = [(*here, pickle.dumps(description.result()))]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _runner(fold: Fold, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, fresh = None, None, True
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            entries = []
            for *slot, description in zip(*columns):
                if fresh or slot[:keys] != here:
                    here, state, fresh = slot[:keys], fold.start, False
                entries.append(pickle.dumps(state))
                state = fold.advance(state, pickle.loads(description))
            yield pa.record_batch([*batch.columns[:-1], pa.array(entries, pa.binary())], names=[*batch.schema.names[:-1], _ENTRY])

    return run


def _walker(fold: Fold, inputs: list[str], kept: list[str], types: list[pa.DataType]):
    names = [f.split()[0] for f in fold.outputs.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = fold.start
        for batch in batches:
            entry = batch.column(_ENTRY)
            columns = [listed(batch.column(c)) for c in inputs]
            found: list[list] = [[] for _ in names]
            at = 0
            for mark in [*np.flatnonzero(entry.is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]:
                if mark > at:
                    state, more = fold.steps(state, *[c[at:mark] for c in columns])
                    for column, values in zip(found, more):
                        column += values
                if mark < batch.num_rows:
                    state = pickle.loads(entry[mark].as_py())
                at = mark + 1
            whole = batch.filter(entry.is_null())
            more = [pa.array(c, t) for c, t in zip(found, types)]
            yield pa.record_batch([*[whole.column(c) for c in kept], *more], names=[*kept, *names])

    return run


def streamed_fold(df: DataFrame, keys: list[str], chunk: Column, order: list[str], inputs: dict[str, Column], fold: Fold) -> DataFrame:
    """Rows of `df` with the columns of `fold.outputs`; `inputs` are what the fold reads of a row.

    The order inside a key must be total for a result that does not depend on the run. NULL keys are a key.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    named = {f"_in_{n}": c for n, c in inputs.items()}
    base = df.withColumns({CHUNK: chunk.cast("long"), **named})
    slot = [*keys, CHUNK]
    at = [F.col(c) for c in slot]
    key_types = [f"{f.name} {f.dataType.simpleString()}" for f in base.select(*slot).schema]
    thin = base.select(*slot, *named, *[F.col(c).alias(f"_by_{c}") for c in order]).repartition(*at)
    thin = thin.sortWithinPartitions(*slot, *[f"_by_{c}" for c in order]).select(*slot, *named)
    schema = ", ".join([*key_types, "_description binary"])
    described = thin.mapInArrow(_describer(fold, len(slot), to_arrow_schema(StructType.fromDDL(schema))), schema)
    along = described.repartition(*[F.col(k) for k in keys]) if keys else described.coalesce(1)
    entries = along.sortWithinPartitions(*slot).mapInArrow(_runner(fold, len(keys)), ", ".join([*key_types, f"{_ENTRY} binary"]))
    both = base.withColumns({_TAG: F.lit(1), _ENTRY: F.lit(None).cast("binary")}).unionByName(
        entries.withColumn(_TAG, F.lit(0)), allowMissingColumns=True)
    walked = both.repartition(*at).sortWithinPartitions(*slot, _TAG, *order)
    out = StructType.fromDDL(fold.outputs)
    shape = StructType([*df.schema.fields, *out.fields])
    types = [f.type for f in to_arrow_schema(out)]
    return walked.mapInArrow(_walker(fold, list(named), df.columns, types), shape)


ship_by_value(__name__)
