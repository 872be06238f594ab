"""Derivatives, portfolio and universe queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import query
from tickloom.operators import derivatives as dv
from tickloom.sources.fixtures import duck, table, view

DAY = 86_400_000_000
OPT, RT = duck("fx_options"), duck("fx_realtime")
SINCE = 1_704_067_200_000_000 + 20 * DAY  # 2024-01-21 00:00 UTC


def options(spark, d):
    return view(spark, d, "fx_options")


def realtime(spark, d):
    return view(spark, d, "fx_realtime")


def futures(spark, d):
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("futures_code"), F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")).alias("underlying"),
        (F.col("s_suppkey") % 3).alias("expiry_idx"), F.expr("date_add(DATE '2024-01-01', CAST(s_suppkey % 90 AS INT))").alias("expiry_date"),
        (100 + F.col("s_suppkey") % 50).cast("double").alias("spot_price"),
        (F.col("s_suppkey") % 90 - 2).alias("days_to_expiry"),
        (F.lit(100.0) + F.col("s_suppkey") % 53).alias("futures_price"),
    )


FUT = """fut AS (SELECT s_suppkey AS futures_code, 'Brand#' || s_nationkey AS underlying, s_suppkey % 3 AS expiry_idx,
  DATE '2024-01-01' + CAST(s_suppkey % 90 AS INT) AS expiry_date, (100 + s_suppkey % 50)::DOUBLE AS spot_price,
  s_suppkey % 90 - 2 AS days_to_expiry, (100 + s_suppkey % 53)::DOUBLE AS futures_price FROM supplier)"""


def r(df, digits: int, *names: str):
    return df.withColumns({c: F.round(c, digits) for c in names})


CODES = """cd AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'futures' ELSE 'options' END AS asset,
   CASE p_size % 3 WHEN 0 THEN '101' WHEN 1 THEN '175' ELSE '999' END AS fu, CASE p_size % 3 WHEN 0 THEN '01' WHEN 1 THEN '05' ELSE '77' END AS ou,
   substr('ABCDEFGHIJKLMNOPQRSTUVWX1', CAST(p_partkey % 25 AS INT) + 1, 1) AS ml, CAST(p_partkey % 400 AS VARCHAR) AS st, p_partkey % 9 = 0 AS short FROM part)"""


@query("parse_instrument_code", "WITH " + CODES + """
SELECT p_partkey, CASE WHEN NOT short THEN CASE asset WHEN 'futures' THEN CASE fu WHEN '101' THEN 'KOSPI200' WHEN '175' THEN 'KTB3Y' ELSE 'Unknown' END
     ELSE CASE ou WHEN '01' THEN 'KOSPI200' WHEN '05' THEN 'KQ150' ELSE 'Unknown' END END END AS underlying,
  CASE WHEN NOT short THEN CASE asset WHEN 'futures' THEN fu ELSE ou END END AS underlying_code,
  CASE WHEN NOT short THEN CASE WHEN ml = '1' THEN 'Unknown' ELSE lpad(CAST((ascii(ml) - 65) % 12 + 1 AS VARCHAR), 2, '0') END END AS month,
  CASE WHEN NOT short THEN ml END AS month_code, CASE WHEN NOT short THEN 'C' END AS year_code,
  CASE WHEN NOT short AND asset = 'options' THEN CASE WHEN p_partkey % 4 = 1 THEN 'Call' ELSE 'Put' END END AS option_type,
  CASE WHEN NOT short AND asset = 'options' THEN CASE WHEN ou = '01' THEN 2.5::DOUBLE ELSE 1 END * ((p_partkey % 400) + 1000) END AS strike_price
FROM cd""")
def _(spark, d):
    rows = table(spark, d, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN 'futures' ELSE 'options' END AS asset",
        """CASE WHEN p_partkey % 9 = 0 THEN '101RC' ELSE concat(
             CASE WHEN p_partkey % 2 = 0 THEN CASE p_size % 3 WHEN 0 THEN '101' WHEN 1 THEN '175' ELSE '999' END
                  ELSE concat(CASE WHEN p_partkey % 4 = 1 THEN '2' ELSE '3' END, CASE p_size % 3 WHEN 0 THEN '01' WHEN 1 THEN '05' ELSE '77' END) END,
             substr('ABCDEFGHIJKLMNOPQRSTUVWX1', CAST(p_partkey % 25 AS INT) + 1, 1), 'C', CAST(p_partkey % 400 + 1000 AS STRING)) END AS code""",
    )
    return dv.parse_instrument_code(rows).drop("asset", "code")


@query("moneyness", OPT + """, m AS (SELECT option_code, CASE WHEN option_code % 17 = 0 THEN 0 ELSE strike_price END AS k, 150 + option_code % 7 AS s FROM fx_options),
x AS (SELECT option_code, CASE WHEN k > 0 THEN s / k END AS m FROM m)
SELECT option_code, round(m, 8) AS moneyness, round(abs(m - 1), 8) AS atm_distance,
       CASE WHEN m > 1 THEN 'ITM' WHEN abs(m - 1) < 0.02 THEN 'ATM' WHEN m IS NOT NULL THEN 'OTM' END AS classification FROM x""")
def _(spark, d):
    rows = options(spark, d).select(
        "option_code", F.when(F.col("option_code") % 17 == 0, 0.0).otherwise(F.col("strike_price")).alias("strike_price"),
        (150 + F.col("option_code") % 7).alias("spot_price"),
    )
    return r(dv.moneyness(rows), 8, "moneyness", "atm_distance").drop("strike_price", "spot_price")


@query("futures_basis", "WITH " + FUT + """, b AS (SELECT *, spot_price > 0 AND days_to_expiry > 0 AS ok, days_to_expiry / 365.0::DOUBLE AS y FROM fut)
SELECT futures_code, CASE WHEN ok THEN round(futures_price - spot_price, 6) END AS basis,
  CASE WHEN ok THEN round((futures_price - spot_price) / spot_price * 100, 6) END AS basis_percentage,
  CASE WHEN ok THEN round(spot_price * (1 + 0.03::DOUBLE * y), 6) END AS theoretical_price,
  CASE WHEN ok THEN round(futures_price - spot_price * (1 + 0.03::DOUBLE * y), 6) END AS premium_discount,
  CASE WHEN ok THEN round((futures_price - spot_price) / y, 6) END AS annualized_basis FROM b""")
def _(spark, d):
    out = dv.futures_basis(futures(spark, d))
    names = ["basis", "basis_percentage", "theoretical_price", "premium_discount", "annualized_basis"]
    return r(out, 6, *names).select("futures_code", *names)


@query("expiry_calendar", """WITH s AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS start FROM orders),
i AS (SELECT start, CAST(i AS INT) AS i FROM s CROSS JOIN range(0, 12) t(i)),
f AS (SELECT start, 'futures' AS contract, i, make_date(CAST(year(start) + i // 4 AS INT), [3, 6, 9, 12][i % 4 + 1], 1) AS fd FROM i
      UNION ALL SELECT start, 'options', i, CAST(date_trunc('month', start + i * 30) AS DATE) FROM i),
e AS (SELECT *, fd + CAST((4 - dayofweek(fd) + 7) % 7 + 7 AS INT) AS ed,
   CASE contract WHEN 'futures' THEN CASE month(fd) WHEN 3 THEN 'H' WHEN 6 THEN 'M' WHEN 9 THEN 'U' ELSE 'Z' END
     ELSE substr('ABCDEFGHIJKL', CAST(month(fd) AS INT), 1) END AS month_code FROM f)
SELECT CAST(start AS VARCHAR) AS start, contract, i, CAST(ed AS VARCHAR) AS expiry_date, CAST(month(fd) AS INT) AS month, CAST(year(fd) AS INT) AS year, month_code,
       right(CAST(year(fd) AS VARCHAR), 1) AS year_code, month_code || right(CAST(year(fd) AS VARCHAR), 1) AS contract_code FROM e""")
def _(spark, d):
    starts = table(spark, d, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("start")).distinct()
    out = dv.expiry_calendar(starts, 12)
    return out.withColumns({"start": F.col("start").cast("string"), "expiry_date": F.col("expiry_date").cast("string")})


QUOTES = "q AS (SELECT event_id % (SELECT count(*) FROM part) AS option_code, event_id AS quote_id, cents / 100.0::DOUBLE AS last_price, ts_us FROM fx_base)"


@query("options_with_quotes", duck("fx_options", "fx_base") + "," + QUOTES + f"""
SELECT option_code, strike_price, option_type, quote_id, last_price FROM fx_options JOIN q USING (option_code) WHERE ts_us > {SINCE}""")
def _(spark, d):
    opts = options(spark, d)
    n = opts.agg(F.count(F.lit(1))).scalar()
    quotes = view(spark, d, "fx_base").select(
        (F.col("event_id") % n).alias("option_code"), F.col("event_id").alias("quote_id"),
        (F.col("cents") / 100).alias("last_price"), "ts_us",
    )
    return dv.options_with_quotes(opts, quotes, SINCE).select("option_code", "strike_price", "option_type", "quote_id", "last_price")


@query("straddles", OPT + """, c AS (
  SELECT strike_price, arg_min(option_code, option_code) FILTER (option_type = 'C') AS call_code, arg_min(option_code, option_code) FILTER (option_type = 'P') AS put_code,
         arg_min(current_price, option_code) FILTER (option_type = 'C') + arg_min(current_price, option_code) FILTER (option_type = 'P') AS total_cost,
         (arg_min(implied_volatility, option_code) FILTER (option_type = 'C') + arg_min(implied_volatility, option_code) FILTER (option_type = 'P')) / 2 AS mean_iv
  FROM fx_options GROUP BY ALL)
SELECT strike_price, call_code, put_code, round(total_cost, 6) AS total_cost, mean_iv FROM c WHERE mean_iv > 20 ORDER BY strike_price LIMIT 3""")
def _(spark, d):
    return r(dv.straddles(options(spark, d)), 6, "total_cost")


@query("derivatives_by_underlying", OPT + "," + FUT + """
SELECT 'futures' AS kind, futures_code AS code, underlying, expiry_idx AS expiry, NULL::DOUBLE AS strike_price FROM fut WHERE underlying LIKE '%Brand#1%'
UNION ALL SELECT 'options', option_code, underlying, expiry_idx, strike_price FROM fx_options WHERE underlying LIKE '%Brand#1%'""")
def _(spark, d):
    return dv.derivatives_by_underlying(futures(spark, d), options(spark, d), "Brand#1")


@query("options_chain", OPT + """
SELECT option_code, underlying, option_type, strike_price, current_price, open_interest FROM fx_options WHERE underlying LIKE '%Brand#12%' AND expiry_idx = 1""")
def _(spark, d):
    return dv.options_chain(options(spark, d), "Brand#12", 1).select(
        "option_code", "underlying", "option_type", "strike_price", "current_price", "open_interest")


@query("screen_liquid_options", OPT + """
SELECT option_code, volume, open_interest FROM fx_options WHERE volume >= 100 OR open_interest >= 1000""")
def _(spark, d):
    return dv.screen_liquid_options(options(spark, d)).select("option_code", "volume", "open_interest")


@query("screen_near_expiry", "WITH " + FUT + """
SELECT futures_code, underlying, CAST(datediff('day', DATE '2024-01-11', expiry_date) AS BIGINT) AS days_to_expiry FROM fut
WHERE datediff('day', DATE '2024-01-11', expiry_date) BETWEEN 1 AND 30""")
def _(spark, d):
    return dv.screen_near_expiry(futures(spark, d), 30, F.lit("2024-01-11").cast("date")).select(
        "futures_code", "underlying", "days_to_expiry")


@query("screen_high_iv", OPT + """
SELECT option_code, implied_volatility, round((SELECT quantile_cont(implied_volatility, 0.8) FROM fx_options), 6) AS threshold FROM fx_options
WHERE implied_volatility >= (SELECT quantile_cont(implied_volatility, 0.8) FROM fx_options)""")
def _(spark, d):
    return r(dv.screen_high_iv(options(spark, d), 0.8), 6, "threshold").select("option_code", "implied_volatility", "threshold")


@query("volatility_signal", OPT + """
SELECT option_code, implied_volatility, 'SELL VOL' AS signal FROM fx_options
WHERE implied_volatility > (SELECT quantile_cont(implied_volatility, 0.8) FROM fx_options) ORDER BY implied_volatility DESC, option_code LIMIT 3""")
def _(spark, d):
    return dv.volatility_signal(options(spark, d), 0.8, 3).select("option_code", "implied_volatility", "signal")


@query("screen_covered_calls", OPT + """
SELECT option_code, strike_price, current_price, round(current_price / strike_price * 100, 6) AS premium_yield FROM fx_options
WHERE option_type = 'C' AND current_price / strike_price * 100 > 1 AND delta < 0.3 ORDER BY strike_price, option_code LIMIT 5""")
def _(spark, d):
    return r(dv.screen_covered_calls(options(spark, d)), 6, "premium_yield").select(
        "option_code", "strike_price", "current_price", "premium_yield")


@query("screen_protective_puts", OPT + """
SELECT option_code, strike_price, current_price, delta FROM fx_options
WHERE option_type = 'P' AND delta > -0.3 AND delta < -0.1 ORDER BY strike_price, option_code LIMIT 5""")
def _(spark, d):
    return dv.screen_protective_puts(options(spark, d)).select("option_code", "strike_price", "current_price", "delta")


@query("put_call_ratio", OPT + """, s AS (SELECT underlying, coalesce(sum(volume) FILTER (option_type = 'C'), 0) AS cv, coalesce(sum(volume) FILTER (option_type = 'P'), 0) AS pv,
  coalesce(sum(open_interest) FILTER (option_type = 'C'), 0) AS co, coalesce(sum(open_interest) FILTER (option_type = 'P'), 0) AS po FROM fx_options GROUP BY ALL),
p AS (SELECT *, CASE WHEN cv > 0 THEN pv / cv ELSE 0 END AS r, CASE WHEN co > 0 THEN po / co ELSE 0 END AS ro FROM s)
SELECT underlying, round(r, 8) AS pcr_volume, round(ro, 8) AS pcr_open_interest, CAST(cv + pv AS BIGINT) AS total_volume, CAST(co + po AS BIGINT) AS total_open_interest,
  CASE WHEN r > 1 THEN 'Bearish' WHEN r BETWEEN 0.8 AND 1.2 THEN 'Neutral' ELSE 'Bullish' END AS market_sentiment FROM p""")
def _(spark, d):
    return r(dv.put_call_ratio(options(spark, d)), 8, "pcr_volume", "pcr_open_interest")


@query("options_chain_summary", OPT + """, k AS (SELECT underlying, strike_price, sum(open_interest) AS oi FROM fx_options GROUP BY ALL),
m AS (SELECT underlying, first(strike_price ORDER BY oi DESC, strike_price) AS max_oi_strike FROM k GROUP BY ALL)
SELECT underlying, count(*) FILTER (option_type = 'C') AS total_calls, count(*) FILTER (option_type = 'P') AS total_puts,
  CAST(coalesce(sum(open_interest) FILTER (option_type = 'C'), 0) AS BIGINT) AS total_call_oi,
  CAST(coalesce(sum(open_interest) FILTER (option_type = 'P'), 0) AS BIGINT) AS total_put_oi,
  max(max_oi_strike) AS max_oi_strike, min(strike_price) AS min_strike, max(strike_price) AS max_strike, round(sum(delta), 6) AS total_delta,
  round(sum(gamma), 6) AS total_gamma, count(DISTINCT expiry_idx) AS expiries FROM fx_options JOIN m USING (underlying) GROUP BY ALL""")
def _(spark, d):
    return r(dv.options_chain_summary(options(spark, d)), 6, "total_delta", "total_gamma")


@query("portfolio_exposure", RT + f""", e AS (SELECT asset_type, count(*) AS positions, sum(current_price * volume) AS mv FROM fx_realtime WHERE ts_us > {SINCE} GROUP BY ALL)
SELECT asset_type, positions, round(mv, 4) AS market_value, round(mv / sum(mv) OVER () * 100, 6) AS share_pct FROM e""")
def _(spark, d):
    out = dv.portfolio_exposure(realtime(spark, d), SINCE)
    return out.withColumns({"market_value": F.round("market_value", 4), "share_pct": F.round("share_pct", 6)})


@query("var_95", RT + f""", l AS (SELECT symbol, arg_max(change_rate, id) AS c FROM fx_realtime WHERE ts_us > {SINCE} GROUP BY ALL)
SELECT count(*) AS symbols, round(avg(c), 6) AS portfolio_return, round(stddev_samp(c), 6) AS portfolio_vol, round(avg(c) - 1.645 * stddev_samp(c), 6) AS var_95 FROM l""")
def _(spark, d):
    return r(dv.var_95(realtime(spark, d), SINCE), 6, "portfolio_return", "portfolio_vol", "var_95")


@query("return_correlation", RT + f""", c AS (SELECT ts_us // {6 * 3_600_000_000} AS cell, symbol, avg(change_rate) AS v FROM fx_realtime
   WHERE ts_us > {SINCE} AND symbol IN ('SYM0', 'SYM1', 'SYM2') GROUP BY ALL)
SELECT a.symbol AS symbol1, b.symbol AS symbol2, round(corr(a.v, b.v), 6) AS correlation, count(*) AS cells
FROM c a JOIN c b ON a.cell = b.cell AND a.symbol < b.symbol GROUP BY ALL""")
def _(spark, d):
    out = dv.return_correlation(realtime(spark, d), ["SYM0", "SYM1", "SYM2"], SINCE, 6 * 3_600_000_000)
    return r(out, 6, "correlation")


@query("momentum_signal", RT + """, m AS (SELECT *, lag(change_rate) OVER (PARTITION BY symbol ORDER BY ts_us, id) AS prev_change FROM fx_realtime)
SELECT id, symbol, asset_type, change_rate, prev_change, volume FROM m
WHERE change_rate > 0 AND change_rate > prev_change AND volume > (SELECT quantile_cont(volume, 0.5) FROM fx_realtime) ORDER BY ts_us DESC, id DESC LIMIT 5""")
def _(spark, d):
    return dv.momentum_signal(realtime(spark, d), 5).select("id", "symbol", "asset_type", "change_rate", "prev_change", "volume")


@query("mean_reversion_signal", RT + """, m AS (SELECT *, avg(change_rate) OVER (PARTITION BY symbol ORDER BY ts_us, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a,
    stddev_samp(change_rate) OVER (PARTITION BY symbol) AS sd FROM fx_realtime)
SELECT id, symbol, asset_type, round(a, 6) AS recent_avg, round((change_rate - a) / sd, 6) AS z_score,
       CASE WHEN change_rate > a THEN 'SELL' ELSE 'BUY' END AS signal FROM m WHERE abs((change_rate - a) / sd) > 1.5""")
def _(spark, d):
    out = dv.mean_reversion_signal(realtime(spark, d), 10, 1.5, rows_per_chunk=500)
    return r(out, 6, "recent_avg", "z_score").select("id", "symbol", "asset_type", "recent_avg", "z_score", "signal")


@query("recent_by_asset", RT + f"""
SELECT id, symbol, asset_type, current_price, change_rate, volume, row_number() OVER (PARTITION BY asset_type ORDER BY ts_us DESC, id DESC) AS rank
FROM fx_realtime WHERE ts_us > {SINCE - DAY} AND ts_us <= {SINCE} QUALIFY rank <= 3""")
def _(spark, d):
    return dv.recent_by_asset(realtime(spark, d), SINCE, 3, DAY).select(
        "id", "symbol", "asset_type", "current_price", "change_rate", "volume", "rank")


SYMS = """sy AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'bybit' ELSE 'okx' END AS exchange,
  CASE c_nationkey % 3 WHEN 0 THEN 'futures' ELSE 'spot' END AS market, 'C' || (c_custkey * 7 % 400) AS base,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'USD' WHEN 'HOUSEHOLD' THEN 'USDT' ELSE c_mktsegment END AS quote FROM customer)"""


def symbols(spark, d):
    return table(spark, d, "customer").selectExpr(
        "CASE c_custkey % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'bybit' ELSE 'okx' END AS exchange",
        "CASE c_nationkey % 3 WHEN 0 THEN 'futures' ELSE 'spot' END AS market", "concat('C', c_custkey * 7 % 400) AS base",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'USD' WHEN 'HOUSEHOLD' THEN 'USDT' ELSE c_mktsegment END AS quote",
    )


@query("common_pairs", "WITH " + SYMS + """, p AS (SELECT base, quote, count(DISTINCT exchange) AS venues, string_agg(DISTINCT exchange, ', ' ORDER BY exchange) AS exchanges
  FROM sy WHERE market = 'spot' AND quote IN ('USDT', 'USD') GROUP BY ALL)
SELECT * FROM p WHERE venues >= 2 ORDER BY venues DESC, base, quote LIMIT 50""")
def _(spark, d):
    return dv.common_pairs(symbols(spark, d))


@query("popular_universe", """WITH c AS (SELECT DISTINCT l_partkey AS code FROM lineitem WHERE l_quantity >= 49)
SELECT p_brand AS market, count(*) AS listed, count(c.code) AS popular FROM part LEFT JOIN c ON p_partkey = c.code GROUP BY ALL""")
def _(spark, d):
    master = table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("market"))
    codes = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("code"))
    return dv.popular_universe(master, codes)


@query("symbol_report", "WITH " + SYMS + """
SELECT exchange, count(*) FILTER (market = 'spot') AS spot, count(*) FILTER (market = 'futures') AS futures, count(*) AS total FROM sy GROUP BY ROLLUP (exchange)""")
def _(spark, d):
    return dv.symbol_report(symbols(spark, d))


@query("quote_asset_topk", "WITH " + SYMS + """, p AS (SELECT exchange, CASE market WHEN 'futures' THEN quote || '_futures' ELSE quote END AS quote_asset, count(*) AS symbols FROM sy GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY exchange ORDER BY symbols DESC, quote_asset) AS rank FROM p QUALIFY rank <= 5""")
def _(spark, d):
    return dv.quote_asset_topk(symbols(spark, d), 5)


@query("asset_counts", duck("fx_options", "fx_realtime") + """
SELECT 'master' AS section, 'options' AS name, count(*) AS rows, NULL::BIGINT AS first_us, NULL::BIGINT AS last_us FROM fx_options
UNION ALL SELECT 'master', 'futures', count(*), NULL, NULL FROM supplier
UNION ALL SELECT 'realtime', asset_type, count(*), min(ts_us), max(ts_us) FROM fx_realtime GROUP BY ALL
UNION ALL (SELECT 'most_active', symbol, count(*), min(ts_us), max(ts_us) FROM fx_realtime GROUP BY ALL ORDER BY count(*) DESC, symbol LIMIT 3)""")
def _(spark, d):
    return dv.asset_counts({"options": options(spark, d), "futures": table(spark, d, "supplier")}, realtime(spark, d), 3)
