"""Price checks against the last accepted value of a key."""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import groupby

from tickloom.plans.streamfold import Description, Fold
from tickloom.session import ship_by_value

#: Room for rounding at the edges of an interval: what lies that close is decided by the check itself.
SLACK = 1e-9


class LastAccepted(Fold):
    """Whether a value is an outlier: off the last accepted value of its key by more than `max_change_pct`.

    A value that passes becomes the one to compare with, an outlier does not; the first value of a key passes. Rows that
    are not eligible or have no value are no outliers and change nothing. So 10, 10, 20, 10 flags the 20 alone.

    A chunk entered with an unknown value: the first row that accepts it resets the path, whatever was before.
    Its description is therefore the rows that can be the first to accept some entry value, each with where its
    path ends. Rows whose interval earlier ones cover cannot, and paths that meet go on as one, so mostly one
    row is left, more where the value wanders further than the limit inside the chunk.
    """

    start = None
    outputs = "is_outlier boolean, last_accepted double"

    def __init__(self, max_change_pct: float):
        self.limit = max_change_pct

    def passes(self, last: float, value: float) -> bool:
        return not abs((value - last) / last) * 100 > self.limit

    def describe(self) -> _Resets:
        return _Resets(self)

    def advance(self, state: float | None, description: list[tuple[float, float]]) -> float | None:
        for first, end in description:
            if state is None or self.passes(state, first):
                return end
        return state

    def step(self, state: float | None, eligible: bool, value: float | None) -> tuple[float | None, tuple]:
        if not eligible or value is None:
            return state, (False, state)
        if state is None or self.passes(state, value):
            return value, (False, value)
        return state, (True, state)


class _Resets(Description):
    def __init__(self, fold: LastAccepted):
        self.fold = fold
        self.rows: list[float] = []
        self.paths: dict[float, list[int]] = {}  # value a path is at -> rows that begin it
        self.covered: list[tuple[float, float]] = []  # disjoint intervals of entry values, ascending

    def add(self, eligible: bool, value: float | None) -> None:
        if not eligible or value is None:
            return
        joined = [v for v in self.paths if v != value and self.fold.passes(v, value)]
        for v in joined:
            self.paths.setdefault(value, []).extend(self.paths.pop(v))
        share = self.fold.limit / 100
        low = value / (1 + share)
        high = value / (1 - share) if share < 1 else float("inf")
        if not self._covers(low * (1 - SLACK), high * (1 + SLACK)):
            self.paths.setdefault(value, []).append(len(self.rows))
            self.rows.append(value)
            self._cover(low * (1 + SLACK), high * (1 - SLACK))

    def _covers(self, low: float, high: float) -> bool:
        at = bisect_left(self.covered, (low, float("inf"))) - 1
        return at >= 0 and self.covered[at][1] >= high

    def _cover(self, low: float, high: float) -> None:
        if not low <= high:
            return
        touched = [c for c in self.covered if c[0] <= high and c[1] >= low]
        for c in touched:
            self.covered.remove(c)
        insort(self.covered, (min([low, *[c[0] for c in touched]]), max([high, *[c[1] for c in touched]])))

    def result(self) -> list[tuple[float, float]]:
        ends = {row: at for at, rows in self.paths.items() for row in rows}
        out = []
        for end, run in groupby(range(len(self.rows)), key=ends.__getitem__):
            out += [(value, end) for value in self._spanning(sorted({self.rows[i] for i in run}))]
        return out

    def _spanning(self, values: list[float]) -> list[float]:
        """Of rows with one end, those whose intervals already make up the union of all."""
        share = self.fold.limit / 100
        kept = values[:1]
        for value, after in zip(values[1:], [*values[2:], None]):
            reach = kept[-1] / (1 - share) * (1 - SLACK) if share < 1 else float("inf")
            if after is None or after / (1 + share) * (1 + SLACK) > reach:
                kept.append(value)
        return kept


ship_by_value(__name__)
