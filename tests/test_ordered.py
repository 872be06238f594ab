"""The chunked helpers against plain windows on data where one key holds most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.plans import ordered as od


def rows(seed: int, n: int = 600):
    rnd = random.Random(seed)
    out, ts = [], 0
    for i in range(n):
        ts += rnd.choice([0, 1, 1, 5, 40, 300])
        key = "hot" if rnd.random() < 0.7 else rnd.choice("abc")
        out.append((key, ts, i, rnd.choice([None, rnd.randint(-50, 50)]), rnd.random() < 0.1))
    return out


def frame(spark, seed):
    return spark.createDataFrame(rows(seed), "k string, ts long, id long, v long, flag boolean")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(a.columns).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_equals_window(spark, seed):
    df = frame(spark, seed)
    w = Window.partitionBy("k").orderBy("ts", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("k").orderBy(F.col("ts").desc(), F.col("id").desc())
    want = df.select(
        "k", "id", F.sum("v").over(upto).alias("s"), F.max("v").over(before).alias("mx"),
        F.last("v", ignorenulls=True).over(upto).alias("ff"), F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("nx"),
        F.min("v").over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("rest"),
    )
    got = od.scan(
        df, ["k"], ["ts", "id"], od.chunk_of("ts", 500), s=od.cumsum(F.col("v")), mx=od.cummax(F.col("v"), "rows_before"),
        ff=od.ffill(F.col("v")), p=od.prev(F.col("v")), nx=od.following(F.col("v")), rest=od.cummin(F.col("v"), reverse=True),
    )
    same(want, got)


def test_scan_range_frame_includes_peers(spark):
    df = frame(spark, 3)
    w = Window.partitionBy("k").orderBy("ts")
    want = df.select("k", "id", F.max(F.when(F.col("flag"), F.col("ts"))).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("e"))
    got = od.scan(df, ["k"], ["ts"], od.chunk_of("ts", 300), e=od.cummax(F.when(F.col("flag"), F.col("ts")), "range"))
    same(want, got)


def test_scan_without_keys(spark):
    df = frame(spark, 4)
    want = df.select("id", F.sum("v").over(Window.orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    same(want, od.scan(df, [], ["ts", "id"], od.chunk_of("ts", 700), s=od.cumsum(F.col("v"))))


@pytest.mark.parametrize("chunk", [50, 100, 1000])
def test_halo_equals_range_frame(spark, chunk):
    df = frame(spark, 5)
    w = Window.partitionBy("k").orderBy("ts").rangeBetween(-100, 0)
    want = df.select("k", "id", F.count("v").over(w).alias("n"), F.sum("v").over(w).alias("s"))
    spread = od.with_halo(df, "ts", 100, chunk)
    fw = od.frame_window(["k"], "ts", 100)
    got = od.drop_halo(spread.withColumns({"n": F.count("v").over(fw), "s": F.sum("v").over(fw)}))
    same(want, got)


def test_asof(spark):
    left, right = frame(spark, 6), frame(spark, 7).filter("v IS NOT NULL")
    got = od.asof(left.select("k", "ts", "id"), right, ["k"], "ts", "ts", ["v", "id"], 400, right_tie="id")
    lr, rr = left.collect(), right.collect()
    for row in got.collect():
        best = max(((r.ts, r.id, r.v) for r in rr if r.k == row.k and r.ts <= row.ts), default=None)
        assert (row.matched.v if row.matched else None) == (best[2] if best else None)
    assert got.count() == len(lr)


def test_order_statistics(spark):
    df = frame(spark, 8).filter("v IS NOT NULL")
    got = od.order_statistics(df, ["k"], "v", {"p90": F.floor((F.col("n") - 1) * 0.9)}, od.chunk_of("v", 7))
    values: dict = {}
    for r in df.collect():
        values.setdefault(r.k, []).append(r.v)
    for r in got.collect():
        vs = sorted(values[r.k])
        assert (r.n, r.p90) == (len(vs), vs[int((len(vs) - 1) * 0.9)])


def test_interval_join(spark):
    points = spark.createDataFrame([("a", p) for p in range(0, 60, 3)], "k string, at long")
    spans = spark.createDataFrame([("a", 0, 10, 1), ("a", 5, 40, 2), ("a", 40, 41, 3), ("b", 0, 60, 4)], "k string, f long, t long, id long")
    got = od.interval_join(points, spans, ["k"], "at", "f", "t", 8).select("at", "id")
    want = {(p, i) for p in range(0, 60, 3) for f, t, i in [(0, 10, 1), (5, 40, 2), (40, 41, 3)] if f <= p < t}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_hot_key_is_split(spark):
    """No task of the window stage sees all rows of the hot key."""
    df = frame(spark, 9).filter("k = 'hot'")
    spread = df.withColumn(od.CHUNK, od.chunk_of("ts", 500)).groupBy(od.CHUNK).count()
    assert spread.count() > 10
    assert spread.agg(F.max("count")).first()[0] < df.count() / 5


def test_choose_chunk_width(spark):
    df = frame(spark, 10)
    width = od.choose_chunk_width(df, ["k"], "ts", [100, 1_000, 10_000, 1_000_000], 60)
    worst = df.groupBy("k", od.chunk_of("ts", width).alias("c")).count().agg(F.max("count")).first()[0]
    assert worst <= 60 and width < 1_000_000


def test_null_keys_form_a_group(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 500, 2), ("a", 2, 5)], "k string, ts long, v long")
    got = od.scan(df, ["k"], ["ts"], od.chunk_of("ts", 10), s=od.cumsum(F.col("v")))
    assert sorted((r.ts, r.s) for r in got.collect()) == [(1, 1), (2, 5), (500, 3)]


def test_summaries_share_the_row_shuffle(spark, sf):
    from tickloom.catalog import registry

    df = registry()["l3_events"].build(spark, sf)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") >= 3


def test_scan_takes_any_column_and_key_type(spark):
    df = spark.createDataFrame([(1.5, 1, {"a": 1}), (1.5, 700, {"b": 2}), (None, 3, None)], "k double, ts int, m map<string,int>")
    got = od.scan(df, ["k"], ["ts"], F.floor(F.col("ts") / 10).cast("int"), n=od.cumsum(F.lit(1)), last=od.prev(F.col("m")))
    assert sorted((r.ts, r.n, r.last) for r in got.collect()) == [(1, 1, None), (3, 1, None), (700, 2, {"a": 1})]


def test_a_scan_read_in_part_deals_its_rows_once(spark):
    df = spark.createDataFrame([("k", i, float(i), "wide") for i in range(40)], "k string, t long, v double, other string")
    out = od.scan(df, ["k"], ["t"], od.chunk_of("t", 10), s=od.cumsum(F.col("v"))).agg(F.min("s").alias("low"))
    assert [r.low for r in out.collect()] == [0]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("ExistingRDD") == 1
