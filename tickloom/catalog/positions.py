"""Position, risk and quoting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import query
from tickloom.operators import positions as ps
from tickloom.sources.fixtures import duck, table, view

DAY = 86_400_000_000
ORDER = ["ts_us", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
CHUNK = 100 * DAY

# A plain row-by-row fold, one recursion step per fill number of a key.
FOLD = "WITH RECURSIVE " + duck("fx_fills").removeprefix("WITH ") + """,
nf AS MATERIALIZED (SELECT *, CASE side WHEN 'buy' THEN quantity ELSE -quantity END AS dq,
  row_number() OVER (PARTITION BY exchange, symbol ORDER BY ts_us, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM fx_fills),
ag AS MATERIALIZED (SELECT rn, list({'e': exchange, 's': symbol, 'dq': dq, 'p': price}) AS f FROM nf GROUP BY rn),
st AS (
  SELECT 0::BIGINT AS rn, exchange, symbol, 0.0::DOUBLE AS q0, 0.0::DOUBLE AS a0, 0.0::DOUBLE AS q, 0.0::DOUBLE AS a, 0.0::DOUBLE AS r, 0.0::DOUBLE AS closed
  FROM (SELECT DISTINCT exchange, symbol FROM fx_fills)
  UNION ALL
  SELECT rn + 1, exchange, symbol, q, a, q + x.dq,
    CASE WHEN q + x.dq = 0 THEN 0 WHEN q * (q + x.dq) <= 0 THEN x.p
         WHEN abs(q + x.dq) > abs(q) THEN (a * abs(q) + x.p * abs(x.dq)) / abs(q + x.dq) ELSE a END,
    CASE WHEN q * x.dq < 0 THEN least(abs(x.dq), abs(q)) * (x.p - a) * sign(q) ELSE 0 END,
    CASE WHEN q * x.dq < 0 THEN least(abs(x.dq), abs(q)) ELSE 0 END
  FROM (SELECT st.*, unnest(list_filter(ag.f, lambda y: y.e = st.exchange AND y.s = st.symbol)) AS x FROM st JOIN ag ON ag.rn = st.rn + 1)),
pp AS (SELECT st.*, nf.ts_us, nf.l_orderkey, nf.l_linenumber, nf.l_partkey, nf.l_suppkey FROM st JOIN nf USING (exchange, symbol, rn)),
ps AS (SELECT exchange, symbol, arg_max(q, rn) AS quantity, arg_max(a, rn) AS avg_price, sum(r) AS realised_pnl, max(ts_us) AS last_ts_us, count(*) AS fills
  FROM pp GROUP BY ALL)
"""


def fills(spark, d):
    return view(spark, d, "fx_fills")


def path(spark, d):
    return ps.position_path(fills(spark, d), ORDER, CHUNK)


def r(df, digits: int, *names: str):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("positions", FOLD + """
SELECT exchange, symbol, quantity, round(avg_price, 4) AS avg_price, round(realised_pnl, 2) AS realised_pnl, last_ts_us, fills FROM ps""")
def _(spark, d):
    return r(r(ps.positions(fills(spark, d), ORDER, CHUNK), 4, "avg_price"), 2, "realised_pnl")


@query("exposure", FOLD + """
SELECT round(sum(abs(quantity) * avg_price), 2) AS total_exposure, count(*) FILTER (quantity <> 0) AS open_positions FROM ps""")
def _(spark, d):
    return r(ps.exposure(ps.positions(fills(spark, d), ORDER, CHUNK)), 2, "total_exposure")


@query("performance", FOLD + """, c AS (SELECT r, sum(r) OVER (ORDER BY ts_us, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS cum FROM pp WHERE closed > 0)
SELECT count(*) AS total_trades, count(*) FILTER (r > 0) AS winning_trades, count(*) FILTER (r < 0) AS losing_trades, round(avg(r) FILTER (r > 0), 3) AS avg_win,
  round(avg(r) FILTER (r < 0), 3) AS avg_loss, round(sum(r), 1) AS total_pnl, round(least(min(cum), 0), 1) AS max_drawdown,
  round(count(*) FILTER (r > 0) / count(*), 8) AS win_rate FROM c""")
def _(spark, d):
    out = ps.performance(path(spark, d), ORDER, CHUNK)
    return r(r(r(out, 3, "avg_win", "avg_loss"), 1, "total_pnl", "max_drawdown"), 8, "win_rate")


@query("daily_pnl", FOLD + f"""
SELECT ts_us // {DAY} AS day, round(sum(r), 2) AS pnl, count(*) AS trades FROM pp WHERE closed > 0 GROUP BY ALL""")
def _(spark, d):
    return r(ps.daily_pnl(path(spark, d)), 2, "pnl")


ORDERS = """od AS (SELECT o_orderkey AS order_id, CASE o_custkey % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'bybit' ELSE 'okx' END AS exchange,
  'SYM' || (o_orderkey % 5) AS symbol, CASE o_orderstatus WHEN 'F' THEN 'buy' ELSE 'sell' END AS side, (o_custkey % 400 + 1)::DOUBLE AS quantity,
  epoch_us(o_orderdate) AS ts_us FROM orders)"""


def orders(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS order_id", "CASE o_custkey % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'bybit' ELSE 'okx' END AS exchange",
        "concat('SYM', o_orderkey % 5) AS symbol", "CASE o_orderstatus WHEN 'F' THEN 'buy' ELSE 'sell' END AS side",
        "CAST(o_custkey % 400 + 1 AS DOUBLE) AS quantity", "unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS ts_us",
        "CAST(o_custkey AS BIGINT) AS account", "o_totalprice / 100 AS price", "(o_orderkey % 10 + 1) / 10 AS size",
    )


@query("risk_audit", FOLD + "," + ORDERS + f""", dx AS (SELECT ts_us, sum(abs(q) * a - abs(q0) * a0) AS x, sum(r) AS p FROM pp GROUP BY ALL),
cx AS (SELECT ts_us, sum(x) OVER (ORDER BY ts_us) AS exposure, sum(p) OVER (PARTITION BY ts_us // {DAY} ORDER BY ts_us) AS pnl FROM dx),
lp AS (SELECT exchange, symbol, ts_us, arg_max(q, rn) AS q FROM pp GROUP BY ALL),
jo AS (SELECT o.*, coalesce(l.q, 0) AS position FROM od o ASOF LEFT JOIN lp l ON o.exchange = l.exchange AND o.symbol = l.symbol AND o.ts_us >= l.ts_us),
jx AS (SELECT j.*, coalesce(c.exposure, 0) AS exposure, CASE WHEN c.ts_us // {DAY} = j.ts_us // {DAY} THEN c.pnl ELSE 0 END AS daily_pnl
  FROM jo j ASOF LEFT JOIN cx c ON j.ts_us >= c.ts_us)
SELECT order_id, position, round(daily_pnl, 2) AS daily_pnl, round(exposure, 1) AS exposure, CASE WHEN daily_pnl < -20000 THEN 'daily_loss'
  WHEN abs(position + CASE side WHEN 'buy' THEN quantity ELSE -quantity END) > 1500 THEN 'position_size' WHEN exposure > 5000000 THEN 'total_exposure' END AS breach FROM jx""")
def _(spark, d):
    out = ps.risk_audit(orders(spark, d), path(spark, d), 1500, 20_000, 5_000_000, CHUNK)
    return out.select("order_id", "position", F.round("daily_pnl", 2).alias("daily_pnl"), F.round("exposure", 1).alias("exposure"), "breach")


@query("orderable_margin", """WITH o AS (SELECT o_orderkey AS order_id, o_custkey, o_totalprice / 100 AS price, (o_orderkey % 10 + 1) / 10 AS size,
   CASE o_orderkey % 5 WHEN 0 THEN 20.0::DOUBLE WHEN 1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS leverage FROM orders)
SELECT order_id, round(coalesce(c_acctbal, 0), 2) AS margin, leverage, CAST(greatest(floor(coalesce(c_acctbal, 0) * 0.8 / (price * size / leverage)), 0) AS BIGINT) AS max_orders
FROM o LEFT JOIN customer ON o_custkey = c_custkey""")
def _(spark, d):
    balances = table(spark, d, "customer").select(
        F.col("c_custkey").alias("account"), F.lit("USDT").alias("asset"), F.col("c_acctbal").alias("amount"))
    brackets = spark.createDataFrame(
        [("SYM0", 1, 20.0), ("SYM0", 2, 10.0), ("SYM1", 1, 5.0)], "symbol string, bracket int, leverage double")
    out = ps.orderable_margin(orders(spark, d), balances, brackets)
    return out.select("order_id", F.round("margin", 2).alias("margin"), "leverage", "max_orders")


@query("rate_limit_violations", f"""WITH o AS (SELECT o_custkey AS account, epoch_us(o_orderdate) // {365 * DAY} * {365 * DAY} AS window_us, count(*) AS orders FROM orders GROUP BY ALL)
SELECT account, window_us, orders, orders - 2 AS excess FROM o WHERE orders > 2""")
def _(spark, d):
    return ps.rate_limit_violations(orders(spark, d), 365 * DAY, 2)


@query("latest_order_status", duck("fx_fills") + """
SELECT l_orderkey AS order_id, arg_max(exchange, k) AS exchange, arg_max(symbol, k) AS symbol, arg_max(side, k) AS status, max(ts_us) AS ts_us
FROM (SELECT *, (ts_us, l_linenumber, l_partkey, l_suppkey) AS k FROM fx_fills WHERE exchange = 'okx') GROUP BY ALL""")
def _(spark, d):
    log = fills(spark, d).withColumnsRenamed({"l_orderkey": "order_id", "side": "status"})
    return ps.latest_order_status(log, ["ts_us", "l_linenumber", "l_partkey", "l_suppkey"], exchange="okx")


MIDS = duck("fx_quotes") + ", m AS (SELECT seq, symbol, (best_bid + best_ask) / 2 AS mid FROM fx_quotes)"


def mids(spark, d):
    return view(spark, d, "fx_quotes").select("seq", "symbol", ((F.col("best_bid") + F.col("best_ask")) / 2).alias("mid"))


@query("quote_ladder", MIDS + """, h AS (SELECT *, CASE symbol WHEN 'SYM0' THEN 0.5::DOUBLE WHEN 'SYM1' THEN -1.0::DOUBLE ELSE 0 END AS skew FROM m),
n AS (SELECT *, CASE WHEN skew > 0 THEN round(4 * ((1 - abs(skew)) * 0.5 + 0.5)) ELSE 4 END AS nb, CASE WHEN skew < 0 THEN round(4 * ((1 - abs(skew)) * 0.5 + 0.5)) ELSE 4 END AS na FROM h),
l AS (SELECT n.*, side, i AS level, CASE side WHEN 'buy' THEN -i ELSE i END AS step FROM n CROSS JOIN (VALUES ('buy'), ('sell')) s(side) CROSS JOIN range(1, 5) t(i)
  WHERE i <= CASE side WHEN 'buy' THEN nb ELSE na END),
p AS (SELECT *, round((round(mid / 0.05::DOUBLE) * 0.05::DOUBLE + step * 0.5::DOUBLE) / 0.05::DOUBLE) * 0.05::DOUBLE AS price FROM l)
SELECT seq, symbol, side, CAST(level AS INT) AS level, skew, round(price, 6) AS price, ceil(greatest(0.01::DOUBLE, 100 / price) * 1000) / 1000 AS quantity FROM p""")
def _(spark, d):
    held = spark.createDataFrame([("SYM0", 0.05), ("SYM1", -0.3)], "symbol string, quantity double")
    out = ps.quote_ladder(mids(spark, d), 0.5, 0.05, 4, positions_df=held)
    return out.select("seq", "symbol", "side", "level", "skew", F.round("price", 6).alias("price"), "quantity")


@query("quote_ladder_stepped", MIDS + """, l AS (SELECT m.*, side, i AS level, CASE side WHEN 'buy' THEN -i ELSE i END AS step FROM m CROSS JOIN (VALUES ('buy'), ('sell')) s(side) CROSS JOIN range(1, 4) t(i)),
p AS (SELECT *, floor((floor(mid * 10) / 10 + step * 0.5::DOUBLE) * 10) / 10 AS price FROM l),
q AS (SELECT *, floor(greatest(0.01::DOUBLE, ceil(100 / price)) * 1000) / 1000 AS quantity FROM p)
SELECT seq, symbol, side, CAST(level AS INT) AS level, round(price, 6) AS price, quantity FROM q WHERE price * quantity >= 100""")
def _(spark, d):
    out = ps.quote_ladder(mids(spark, d), 0.5, 0.1, 3, style="stepped")
    return out.select("seq", "symbol", "side", "level", F.round("price", 6).alias("price"), "quantity")
