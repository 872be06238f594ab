"""What feeds several parts of a query runs once."""

from __future__ import annotations

import random

import pytest

from tickloom.catalog import registry
from tickloom.operators import ladders


def lineitems(spark, folder):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 9), rnd.randint(0, 5), i % 3, float(rnd.randint(1, 5)), 100.0 + i % 7, rnd.choice([0.0, 0.06]), rnd.choice("NAR"), rnd.choice("OF"), 720 + rnd.randint(0, 120))
            for i in range(1500)]
    names = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, "
             "l_linestatus string, day int")
    spark.createDataFrame(rows, names).selectExpr("*", "cast(date_add(date '1993-01-01', day) as timestamp) as l_shipdate").drop("day").write.parquet(f"{folder}/lineitem.parquet")


@pytest.mark.parametrize("name,reads", [("restored_books", 0), ("asof_trades_to_books", 1), ("features", 1), ("signals", 1)])
def test_levels_are_aggregated_once(spark, tmp_path, name, reads):
    """Trades read the table themselves; all else comes from the stored levels."""
    lineitems(spark, tmp_path)
    out = registry()[name].build(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") > 0 or reads == 0
    assert sum("Relation [" in line and "l_shipdate" in line for line in plan.splitlines()) == reads
    assert reads or out.count()


def test_segments_guesses_and_rounds_read_the_levels_once(spark):
    rnd, seen = random.Random(5), spark.sparkContext.accumulator(0)
    rows = [("x", "s", seq, seq // 50 * 50, seq % 50 == 0, side, rnd.randint(1, 30)) for seq in range(100) for side in ("bid", "ask")]
    rows = [(*r, float(r[-1]), float(rnd.randint(0, 3))) for r in rows]

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    names = "exchange string, symbol string, seq long, epoch long, is_snapshot boolean, side string, price_ticks long, price double, quantity double"
    levels = spark.createDataFrame(rows, names)
    got = ladders.truncated(levels.mapInPandas(counted, names), 10, 3)
    assert got.count() and seen.value == len(rows)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in ladders.truncated(levels, 1000, 3).collect()}
