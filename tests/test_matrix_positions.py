"""Correlations by tiles against numpy, and positions in integers."""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest

from tickloom.operators import derivatives as dv
from tickloom.operators import positions as ps


def test_correlations_equal_numpy_over_tiles_and_slabs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    symbols, cells = [f"S{i}" for i in range(150)], 60
    x = rng.standard_normal((cells, 3)) @ rng.standard_normal((3, 150)) + rng.standard_normal((cells, 150)) + 1000
    x[:, 7] = 5.0  # no spread
    seen = rng.random((cells, 150)) < 0.6
    seen[:, 9] = False
    seen[1:, 11] = False
    rows = [(symbols[j], int(t), int(t * 150 + j), float(x[t, j])) for t in range(cells) for j in range(150) if seen[t, j]]
    df = spark.createDataFrame(rows, "symbol string, ts_us long, id long, change_rate double")
    want = {}
    for a in range(150):
        for b in range(a + 1, 150):
            both = seen[:, a] & seen[:, b]
            if both.any():
                p, q = x[both, a], x[both, b]
                flat = both.sum() < 2 or p.std() < 1e-12 or q.std() < 1e-12
                want[symbols[a], symbols[b]] = (None if flat else float(np.corrcoef(p, q)[0, 1]), int(both.sum()))
    monkeypatch.setattr(dv, "BLOCK_CELLS", 1)
    for slab in (7, 1000):
        got = {(r.symbol1, r.symbol2): (r.correlation, r.cells) for r in dv.return_correlation(df, symbols, -1, 1, slab).collect()}
        assert set(got) == set(want)
        for pair, (value, n) in want.items():
            assert got[pair][1] == n and (got[pair][0] is None if value is None else got[pair][0] == pytest.approx(value, abs=1e-9)), pair


def test_the_plan_does_not_grow_with_the_symbols(spark):
    df = spark.createDataFrame([("a", 1, 1, 1.0)], "symbol string, ts_us long, id long, change_rate double")
    sizes = [len(dv.return_correlation(df, [f"S{i}" for i in range(n)], 0)._jdf.queryExecution().optimizedPlan().toString()) for n in (3, 2000)]
    assert sizes[1] < sizes[0] * 1.5 + 500


FILLS = "exchange string, symbol string, ts_us long, id long, side string, quantity double, price double"


def test_tenths_close_a_position(spark):
    df = spark.createDataFrame([("x", "s", i, i, side, q, 100.0) for i, (side, q) in enumerate([("buy", 0.1), ("buy", 0.2), ("sell", 0.3)])], FILLS)
    row = ps.positions(df, ["ts_us", "id"]).first()
    assert (row.quantity, row.avg_price, row.realised_pnl) == (0.0, 0.0, 0.0)


def exact(rows):
    q, avg, total, out = Fraction(0), Fraction(0), Fraction(0), {}
    for _, _, _, i, side, quantity, price in rows:
        dq, p = Fraction(round(quantity * 1e8), 10**8) * (1 if side == "buy" else -1), Fraction(price)
        gain = min(abs(dq), abs(q)) * (p - avg) * (1 if q > 0 else -1) if q * dq < 0 else Fraction(0)
        after = q + dq
        avg = Fraction(0) if after == 0 else p if q * after <= 0 else (avg * abs(q) + p * abs(dq)) / abs(after) if abs(after) > abs(q) else avg
        q, total = after, total + gain
        out[i] = (float(q), float(avg), float(gain), float(total))
    return out


def test_any_cut_of_the_path_gives_the_same_doubles(spark):
    rnd = random.Random(4)
    rows = [("x", None, i // 3, i, rnd.choice(["buy", "sell"]), rnd.choice([0.1, 0.2, 0.3, 1.7, 12.0]), rnd.uniform(90, 110)) for i in range(400)]
    want, seen = exact(rows), []
    for cut, chunk_us in ((1, 5), (7, 50), (100_000, 10**9)):
        got = ps.position_path(spark.createDataFrame(rows, FILLS), ["ts_us", "id"], chunk_us, rows=cut).collect()
        seen.append({r.id: (r.q_after, r.avg_after, r.realised, r.realised_total) for r in got})
        for i, r in seen[-1].items():
            assert r == pytest.approx(want[i], rel=1e-14, abs=1e-14), (cut, i)
    assert seen[0] == seen[1] == seen[2]


def test_a_risk_audit_walks_the_path_once(spark):
    rows = [("x", "s", i // 2, i, "buy" if i % 3 else "sell", 1.0 + i % 4, 100.0 + i % 7) for i in range(60)]
    path = ps.position_path(spark.createDataFrame(rows, FILLS).repartition(2, "id"), ["ts_us", "id"], 10)
    orders = spark.createDataFrame([(1, "x", "s", "buy", 2.0, 9), (2, "x", "s", "sell", 2.0, 29), (3, "y", "s", "buy", 1.0, 29)],
                                   "order_id long, exchange string, symbol string, side string, quantity double, ts_us long")
    out = ps.risk_audit(orders, path, 1e9, 1e9, 1e9, 10).select("order_id", "position", "exposure", "daily_pnl")
    got = {r.order_id: r for r in out.collect()}
    want = exact(rows)
    for order, at in ((1, 19), (2, 59)):
        q, average, _, total = want[at]
        assert got[order].position == q and got[order].exposure == pytest.approx(abs(q) * average)
        assert got[order].daily_pnl == pytest.approx(total)
    assert got[3].position == 0
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 3  # describe, enter, walk
