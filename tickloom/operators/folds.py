"""Exact sequential folds of a key, chunk by chunk (`plans.streamfold`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.plans.streamfold import Description, Fold, streamed_fold
from tickloom.session import ship_by_value

_BOTH = 3  # state of a half-collected book: bit 0 bids held, bit 1 asks held


class CompleteBooks(Fold):
    """Whether a row completes a book: the last packet of a burst finds both sides, and both clear.

    The state is two bits, so a chunk is described by where each of the four states ends.
    """

    start = 0
    outputs = "emits boolean"

    def step(self, state: int, is_bid: bool, is_last: bool) -> tuple[int, tuple]:
        state |= 1 if is_bid else 2
        return (0, (True,)) if is_last and state == _BOTH else (state, (False,))

    def describe(self) -> _Ends:
        return _Ends(self)

    def advance(self, state: int, ends: list[int]) -> int:
        return ends[state]


class _Ends(Description):
    def __init__(self, fold: CompleteBooks):
        self.fold, self.ends = fold, [0, 1, 2, _BOTH]

    def add(self, *values) -> None:
        self.ends = [self.fold.step(e, *values)[0] for e in self.ends]

    def result(self) -> list[int]:
        return self.ends


def complete_books(df: DataFrame, keys: list[str], chunk: Column, order: list[str]) -> DataFrame:
    """Add `emits`: whether a row (side, is_last) completes a book, both sides clearing on it."""
    inputs = {"is_bid": F.col("side") == "bid", "is_last": F.col("is_last")}
    return streamed_fold(df, keys, chunk, order, inputs, CompleteBooks())


BITS = 100
ONE = 1 << BITS


SHOWN = float(1 << 72)


def shown(value: int, units: int) -> float:
    """value / (units ONE) as a double, first rounded to 2^-72: what the order of composing left beyond that is no difference."""
    return ((value >> BITS - 73) // units + 1 >> 1) / SHOWN


class AverageCost(Fold):
    """Average entry price and realised profit by average cost.

    A row brings the whole quantities before and after it, exact counts of a smallest unit, and its price. Growing blends
    the average, shrinking keeps it, flipping restarts it at the price, closing ends it. Each of these is linear in the average so far, and
    so is the profit; a chunk is therefore four numbers. They are integers of 100 binary places, so that cutting
    the path into other chunks moves a result by far less than a double can show.
    """

    start = (0, 0)
    outputs = "avg_before double, avg_after double, closed_units long, realised double, realised_total double"

    def __init__(self, units: int):
        self.units = units

    def step(self, state: tuple[int, int], *values) -> tuple[tuple[int, int], tuple]:
        state, columns = self.steps(state, *[[v] for v in values])
        return state, tuple(c[0] for c in columns)

    def steps(self, state: tuple[int, int], befores: list, afters: list, prices: list) -> tuple[tuple[int, int], list[list]]:
        # one flat loop: this runs once for every fill
        average, total = state
        mean, profit = shown(average, 1), shown(total, self.units)
        found = means_before, means_after, closed_units, gains, totals = [], [], [], [], []
        units, one = self.units, float(ONE)
        for before, after, price in zip(befores, afters, prices):
            means_before.append(mean)
            closed, gain = 0, 0.0
            if before is not None and after is not None and price is not None:
                at = int(price * one)
                was, old, new = average, abs(before), abs(after)
                if before * after <= 0:
                    closed, average = before, at if after else 0
                elif new > old:
                    average = ((old << BITS) // new * average >> BITS) + at * (new - old) // new
                else:
                    closed = before - after
                if closed:
                    more = closed * (at - was)
                    total += more
                    gain, profit = shown(more, units), shown(total, units)
                if average != was:
                    mean = ((average >> BITS - 73) + 1 >> 1) / SHOWN
            means_after.append(mean)
            closed_units.append(abs(closed))
            gains.append(gain)
            totals.append(profit)
        return (average, total), list(found)

    def describe(self) -> _Linear:
        return _Linear()

    def advance(self, state: tuple[int, int], description: tuple[int, int, int, int]) -> tuple[int, int]:
        average, total = state
        a, b, gain_a, gain_b = description
        return (a * average >> BITS) + b, total + (gain_a * average >> BITS) + gain_b


class _Linear(Description):
    """The average becomes a x average + b, and the profit grows by gain_a x average + gain_b."""

    def __init__(self):
        self.a, self.b, self.gain_a, self.gain_b = ONE, 0, 0, 0

    def extend(self, befores: list, afters: list, prices: list) -> None:
        a, b, gain_a, gain_b, one = self.a, self.b, self.gain_a, self.gain_b, float(ONE)
        for before, after, price in zip(befores, afters, prices):
            if before is None or after is None or price is None:
                continue
            at = int(price * one)
            old, new = abs(before), abs(after)
            if before * after <= 0:
                gain_a -= before * a
                gain_b += before * (at - b)
                a, b = 0, at if after else 0
            elif new > old:
                kept = (old << BITS) // new
                a, b = kept * a >> BITS, (kept * b >> BITS) + at * (new - old) // new
            else:
                gain_a -= (before - after) * a
                gain_b += (before - after) * (at - b)
        self.a, self.b, self.gain_a, self.gain_b = a, b, gain_a, gain_b

    def result(self) -> tuple[int, int, int, int]:
        return self.a, self.b, self.gain_a, self.gain_b


def average_cost(df: DataFrame, keys: list[str], chunk: Column, order: list[str], units: int) -> DataFrame:
    """Add avg_before, avg_after, closed_units, realised and realised_total to rows with `units_before`, `units_after` and `price`."""
    inputs = {"before": F.col("units_before"), "after": F.col("units_after"), "price": F.col("price").cast("double")}
    return streamed_fold(df, keys, chunk, order, inputs, AverageCost(units))


ship_by_value(__name__)
