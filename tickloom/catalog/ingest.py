"""Ingest queries. Raw messages are spelled from the event table in each venue's format; the
oracles compute the expected rows from the same events without any JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import query
from tickloom.catalog.scalars import dim_symbol
from tickloom.operators import ingest as ing
from tickloom.session import shared_dir
from tickloom.sources import files
from tickloom.sources.fixtures import duck, table, view

BASE = duck("fx_base")
HOUR_MS = 3_600_000

# Text pieces over fx_base: price P.PP, quantity K.5, milliseconds, symbol.
P = "concat(100 + 10 * (user_id % 5), '.', lpad(CAST(cents % 100 AS STRING), 2, '0'))"
HI = "concat(101 + 10 * (user_id % 5), '.', lpad(CAST(cents % 100 AS STRING), 2, '0'))"
Q = "concat(k, '.5')"
MS = "CAST(ts_us div 1000 AS STRING)"
ISO = "concat(replace(CAST(timestamp_millis(ts_us div 1000) AS STRING), ' ', 'T'), 'Z')"


def raw(spark, d, venue: str, template: str):
    """Messages from a template: [P], [HI], [Q], [MS], [ISO], [S] and [ID] are filled in per event."""
    parts = {"[P]": P, "[HI]": HI, "[Q]": Q, "[MS]": MS, "[ISO]": ISO, "[S]": "symbol", "[ID]": "CAST(event_id AS STRING)"}
    pieces, text = [], template
    while text:
        hits = [(text.index(m), m) for m in parts if m in text]
        if not hits:
            pieces.append("'" + text + "'")
            break
        at, mark = min(hits)
        if at:
            pieces.append("'" + text[:at] + "'")
        pieces.append(parts[mark])
        text = text[at + len(mark):]
    return "concat(" + ", ".join(pieces) + ")"


def messages(spark, d, venue: str, cases: dict[str, str]):
    """raw_messages of one venue; `cases` maps an event type to its message template."""
    body = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {raw(spark, d, venue, t)}" for k, t in cases.items()) + " END"
    return view(spark, d, "fx_base").select(
        F.lit(venue).alias("exchange"), F.lit("spot").alias("asset_type"), F.col("event_id").alias("recv_seq"),
        F.expr("ts_us div 1000 + 5").alias("recv_ms"), F.expr(body).alias("payload"),
    ).filter(F.col("payload").isNotNull())


def flat(df):
    """Level lists as text, so that rows compare as plain values."""
    def text(name):
        item = F.transform(name, lambda x: F.concat_ws(":", x["price_e8"].cast("string"), x["qty_e8"].cast("string")))
        return F.when(F.col(name).isNotNull(), F.array_join(item, "|")).alias(name)

    return df.select(
        "recv_seq", "kind", "symbol", "ts_ms", "price_e8", "qty_e8", "side", "is_snapshot", "update_id", text("bids"), text("asks")
    )


PE = "((100 + 10 * (user_id % 5)) * 100000000 + cents % 100 * 1000000)"
HE = f"({PE} + 100000000)"
QE = "(k * 100000000 + 50000000)"
TS = "ts_us // 1000"
ONE_BID, ONE_ASK = f"{PE} || ':' || {QE}", f"{HE} || ':' || {QE}"


def rows_sql(kind: str, where: str, symbol: str, ts: str = TS, side: str = "NULL", snap: str = "NULL", uid: str = "NULL",
             bids: str = "NULL", asks: str = "NULL", price: str = PE, qty: str = QE, k: str | None = None) -> str:
    book = kind == "book"
    return f"""SELECT event_id AS recv_seq, '{k or kind}' AS kind, {symbol} AS symbol, {ts} AS ts_ms,
      {'NULL' if book else price} AS price_e8, {'NULL' if book else qty} AS qty_e8, {side} AS side, {snap} AS is_snapshot,
      CAST({uid} AS BIGINT) AS update_id, {bids if book else 'NULL'} AS bids, {asks if book else 'NULL'} AS asks FROM fx_base WHERE {where}"""


def dim(spark, venue: str, native: str, common: str = "SYM{}-USDT"):
    return spark.createDataFrame(
        [(venue, native.format(i), common.format(i)) for i in range(4)], "exchange string, native_symbol string, common_symbol string"
    )


COMMON = "symbol || '-USDT'"
KEEP = "CASE WHEN symbol = 'SYM4' THEN {} ELSE symbol || '-USDT' END"

BINANCE = {
    "click": '{"stream":"[S]usdt@trade","data":{"e":"trade","E":[MS],"s":"[S]USDT","t":[ID],"p":"[P]","q":"[Q]","T":[MS],"m":true}}',
    "purchase": '{"e":"trade","E":[MS],"s":"[S]USDT","t":[ID],"p":"[P]","q":"[Q]","T":[ID],"m":false}',
    "view": '{"stream":"[S]usdt@depth@100ms","data":{"e":"depthUpdate","E":[MS],"s":"x","U":[ID],"u":[ID],"pu":[ID],'
            '"b":[["[P]","[Q]"],["[HI]","0"]],"a":[["[HI]","[Q]"]]}}',
    "signup": '{"s":"[S]USDT","lastUpdateId":[ID],"bids":[["[P]","[Q]"]],"asks":[["[HI]","[Q]"]]}',
    "error": '{"result":null,"id":[ID]}',
}


@query("normalize_binance", BASE + "SELECT * FROM (" + " UNION ALL ".join([
    rows_sql("trade", "event_type = 'click' AND symbol <> 'SYM4'", COMMON, side="'sell'"),
    rows_sql("trade", "event_type = 'purchase' AND symbol <> 'SYM4'", COMMON, ts=f"{TS} + 5", side="'buy'"),
    rows_sql("book", "event_type = 'view' AND symbol <> 'SYM4'", COMMON, snap="false", uid="event_id",
             bids=f"{ONE_BID} || '|' || {HE} || ':0'", asks=ONE_ASK),
    rows_sql("book", "event_type = 'signup' AND symbol <> 'SYM4'", COMMON, ts=f"{TS} + 5", snap="true", uid="event_id",
             bids=ONE_BID, asks=ONE_ASK),
]) + ")")
def _(spark, d):
    return flat(ing.normalize_binance(messages(spark, d, "binance", BINANCE), dim(spark, "binance", "SYM{}USDT")))


BYBIT = {
    "click": '{"topic":"publicTrade.[S]USDT","type":"snapshot","ts":[MS],"data":[{"T":[MS],"s":"[S]USDT","S":"Buy","v":"[Q]","p":"[P]","i":"[ID]"},'
             '{"T":[MS],"s":"[S]USDT","S":"Sell","v":"[Q]","p":"[HI]","i":"[ID]b"}]}',
    "purchase": '{"topic":"publicTrade.[S]USDT","data":{"T":[MS],"s":"[S]USDT","S":"Sell","v":"[Q]","p":"[P]","i":"[ID]"}}',
    "view": '{"topic":"orderbook.50.[S]USDT","type":"delta","ts":[MS],"data":{"s":"[S]USDT","b":[["[P]","0"]],"a":[["[HI]","[Q]"]],"u":[ID],"seq":7}}',
    "signup": '{"topic":"orderbook.50.[S]USDT","type":"snapshot","cts":[MS],"data":{"s":"[S]USDT","b":[["[P]","[Q]"]],"a":[],"u":[ID],"seq":7}}',
    "error": '{"success":true,"op":"subscribe"}',
}
BY = KEEP.format("symbol || 'USDT'")


@query("normalize_bybit", BASE + "SELECT * FROM (" + " UNION ALL ".join([
    rows_sql("trade", "event_type = 'click'", BY, side="'buy'"),
    rows_sql("trade", "event_type = 'click'", BY, side="'sell'", price=HE),
    rows_sql("trade", "event_type = 'purchase'", BY, side="'sell'"),
    rows_sql("book", "event_type = 'view'", BY, snap="false", uid="event_id", bids=f"{PE} || ':0'", asks=ONE_ASK),
    rows_sql("book", "event_type = 'signup'", BY, snap="true", uid="event_id", bids=ONE_BID, asks="''"),
]) + ")")
def _(spark, d):
    return flat(ing.normalize_bybit(messages(spark, d, "bybit", BYBIT), dim(spark, "bybit", "SYM{}USDT")))


OKX = {
    "click": '{"arg":{"channel":"trades","instId":"[S]-USD"},"data":[{"px":"[P]","sz":"[Q]","ts":"[MS]","side":"buy","tradeId":"[ID]"}]}',
    "purchase": '{"arg":{"channel":"trades","instId":"[S]-USD"},"data":[{"px":"[HI]","sz":"[Q]","ts":"[MS]","side":"sell","tradeId":"[ID]"}]}',
    "view": '{"arg":{"channel":"books5","instId":"[S]-USD"},"data":[{"bids":[["[P]","[Q]","0","4"],["1"]],"asks":[["[HI]","[Q]","0","2"]],"ts":"[MS]","seqId":[ID],"prevSeqId":[ID]}]}',
    "signup": '{"arg":{"channel":"books","instId":"[S]-USD"},"data":[{"bids":[["[P]","[Q]"]],"asks":[],"ts":"[MS]"}]}',
    "error": '{"event":"subscribe","arg":{"channel":"trades","instId":"[S]-USD"}}',
}
OK = KEEP.format("symbol || '-USD'")


@query("normalize_okx", BASE + "SELECT * FROM (" + " UNION ALL ".join([
    rows_sql("trade", "event_type = 'click'", OK, side="'buy'"),
    rows_sql("trade", "event_type = 'purchase'", OK, side="'sell'", price=HE),
    rows_sql("book", "event_type = 'view'", OK, snap="true", uid="event_id", bids=ONE_BID, asks=ONE_ASK),
]) + ")")
def _(spark, d):
    return flat(ing.normalize_okx(messages(spark, d, "okx", OKX), dim(spark, "okx", "SYM{}-USD")))


COINBASE = {
    "click": '{"channel":"market_trades","timestamp":"[ISO]","sequence_num":[ID],"events":[{"type":"update","trades":[{"product_id":"[S]-USD","price":"[P]","size":"[Q]","time":"[ISO]","side":"BUY","trade_id":"[ID]"}]}]}',
    "view": '{"channel":"l2_data","timestamp":"[ISO]","sequence_num":[ID],"events":[{"type":"snapshot","product_id":"[S]-USD","updates":[{"side":"bid","event_time":"[ISO]","price_level":"[P]","new_quantity":"[Q]"},{"side":"ask","event_time":"[ISO]","price_level":"[HI]","new_quantity":"[Q]"},{"side":"offer","event_time":"[ISO]","price_level":"1","new_quantity":"1"}]}]}',
    "signup": '{"type":"l2update","product_id":"[S]-USD","time":"[ISO]","changes":[["buy","[P]","0"],["sell","[HI]","[Q]"],["sell","1"]]}',
    "purchase": '{"type":"ticker","product_id":"[S]-USD","price":"[P]","last_size":"[Q]","time":"[ISO]"}',
    "error": '{"type":"snapshot","product_id":"[S]-USD","bids":[["[P]","[Q]"]],"asks":[["[HI]","[Q]"]]}',
}


@query("normalize_coinbase", BASE + "SELECT * FROM (" + " UNION ALL ".join([
    rows_sql("trade", "event_type = 'click'", OK, side="'buy'"),
    rows_sql("trade", "event_type = 'purchase'", OK),
    rows_sql("book", "event_type = 'view'", OK, snap="true", uid="event_id", bids=ONE_BID, asks=ONE_ASK),
    rows_sql("book", "event_type = 'signup'", OK, snap="false", bids=f"{PE} || ':0'", asks=ONE_ASK),
    rows_sql("book", "event_type = 'error'", OK, ts=f"{TS} + 5", snap="true", bids=ONE_BID, asks=ONE_ASK),
]) + ")")
def _(spark, d):
    return flat(ing.normalize_coinbase(messages(spark, d, "coinbase", COINBASE), dim(spark, "coinbase", "SYM{}-USD")))


DERIBIT = {
    "click": '{"method":"subscription","params":{"channel":"trades.[S]-PERP.raw","data":[{"instrument_name":"[S]-PERP","price":[P],"amount":[Q],"timestamp":[MS],"direction":"sell","trade_id":"[ID]"}]}}',
    "purchase": '{"method":"subscription","params":{"channel":"trades.[S]-PERP.raw","data":[{"instrument_name":"[S]-PERP","price":[HI],"amount":[Q],"timestamp":[MS],"direction":"buy","trade_id":"[ID]"}]}}',
    "view": '{"method":"subscription","params":{"channel":"book.[S]-PERP.100ms","data":{"type":"change","instrument_name":"[S]-PERP","timestamp":[MS],"change_id":[ID],"prev_change_id":[ID],"bids":[["new",[P],[Q]],["delete",[HI],[Q]]],"asks":[["change",[HI],[Q]],["new",1]]}}}',
    "signup": '{"method":"subscription","params":{"channel":"ticker.[S]-PERP.100ms","data":{"instrument_name":"[S]-PERP","timestamp":[MS],"last_price":[P],"stats":{"volume":[Q]}}}}',
    "error": '{"id":[ID],"result":["trades"]}',
}
DB = KEEP.format("symbol || '-PERP'")


@query("normalize_deribit", BASE + "SELECT * FROM (" + " UNION ALL ".join([
    rows_sql("trade", "event_type = 'click'", DB, side="'sell'"),
    rows_sql("trade", "event_type = 'purchase'", DB, side="'buy'", price=HE),
    rows_sql("trade", "event_type = 'signup'", DB, k="ticker"),
    rows_sql("book", "event_type = 'view'", DB, snap="false", uid="event_id", bids=f"{ONE_BID} || '|' || {HE} || ':0'", asks=ONE_ASK),
]) + ")")
def _(spark, d):
    return flat(ing.normalize_deribit(messages(spark, d, "deribit", DERIBIT), dim(spark, "deribit", "SYM{}-PERP")))


UPBIT = {
    "click": '{"type":"trade","code":"KRW-[S]","trade_price":[P],"trade_volume":[Q],"trade_timestamp":[MS],"ask_bid":"BID","sequential_id":[ID]}',
    "purchase": '{"type":"trade","code":"KRW-[S]","trade_price":[HI],"trade_volume":[Q],"trade_timestamp":[MS],"ask_bid":"ASK","sequential_id":[ID]}',
    "view": '{"type":"orderbook","code":"KRW-[S]","timestamp":[MS],"orderbook_units":[{"ask_price":[HI],"bid_price":[P],"ask_size":[Q],"bid_size":[Q]},{"ask_price":[HI],"bid_price":[P],"ask_size":1}]}',
    "signup": '{"type":"trade","code":"","trade_price":[P],"trade_volume":[Q],"trade_timestamp":[MS]}',
    "error": '{"status":"UP"}',
}


@query("normalize_upbit", BASE + "SELECT * FROM (" + " UNION ALL ".join([
    rows_sql("trade", "event_type = 'click' AND symbol <> 'SYM4'", "symbol || '-KRW'", side="'buy'"),
    rows_sql("trade", "event_type = 'purchase' AND symbol <> 'SYM4'", "symbol || '-KRW'", side="'sell'", price=HE),
    rows_sql("book", "event_type = 'view' AND symbol <> 'SYM4'", "symbol || '-KRW'", snap="true", bids=ONE_BID,
             asks=f"{ONE_ASK} || '|' || {HE} || ':100000000'"),
]) + ")")
def _(spark, d):
    return flat(ing.normalize_upbit(messages(spark, d, "upbit", UPBIT), dim(spark, "upbit", "KRW-SYM{}", "SYM{}-KRW")))


BITHUMB = {
    "click": '{"type":"trade","code":"KRW-[S]","trade_price":[P],"trade_volume":[Q],"trade_timestamp":[MS],"ask_bid":"ASK"}',
    "purchase": '{"type":"trade","cd":"KRW-[S]","tp":[P],"ttms":[MS],"ab":"BID"}',
    "signup": '{"type":"trade","code":"KRW-[S]","trade_price":[HI],"trade_volume":[Q],"trade_timestamp":[MS],"ask_bid":"BID"}',
    "view": '{"type":"orderbook","code":"KRW-[S]","timestamp":[MS],"orderbook_units":[{"ask_price":[HI],"bid_price":[P],"ask_size":[Q],"bid_size":[Q]}]}',
    "error": '{"status":"0000"}',
}


@query("normalize_bithumb", BASE + "SELECT * FROM (" + " UNION ALL ".join([
    rows_sql("trade", "event_type = 'click' AND symbol <> 'SYM4'", "symbol || '-KRW'", side="'sell'"),
    rows_sql("trade", "event_type = 'purchase' AND symbol <> 'SYM4'", "symbol || '-KRW'", side="'buy'", qty="100000000"),
    rows_sql("trade", "event_type = 'signup' AND symbol <> 'SYM4'", "symbol || '-KRW'", side="'buy'", price=HE),
    rows_sql("book", "event_type = 'view' AND symbol <> 'SYM4'", "symbol || '-KRW'", snap="true", bids=ONE_BID, asks=ONE_ASK),
]) + ")")
def _(spark, d):
    return flat(ing.normalize_bithumb(messages(spark, d, "bithumb", BITHUMB), dim(spark, "bithumb", "KRW-SYM{}", "SYM{}-KRW")))


LS = {
    "click": '{"header":{"tr_cd":"S3_"},"body":{"shcode":"[S]","price":[P],"cvolume":[ID]}}',
    "view": '{"header":{"tr_cd":"H1_"},"body":{"shcode":"[S]","bidho1":[P],"bidrem1":[ID],"bidho2":0,"bidrem2":5,"offerho1":[HI],"offerrem1":[ID],"offerho3":[HI],"offerrem3":2}}',
    "purchase": '{"header":{"tr_cd":"FC_"},"body":{"futcode":"[S]","basecode":"101","lastdate":"20240314","price":[P],"volume":[ID],"openinterest":[ID],"basis":0.25,"settlement":[HI]}}',
    "signup": '{"header":{"tr_cd":"OC_"},"body":{"optcode":"[S]","basecode":"201","lastdate":"20240314","actprice":[HI],"opttype":"C","price":[P],"volume":[ID],"impvol":20.5,"delta":0.5,"gamma":0.01,"theta":-0.1,"vega":0.2,"rho":0.05,"openinterest":[ID]}}',
    "error": '{"header":{"tr_cd":"VI_"},"body":{"shcode":"[S]"}}',
}
LS_P = "(100 + 10 * (user_id % 5) + (cents % 100) / 100)"


@query("normalize_ls", BASE + f"""
SELECT event_id AS recv_seq, CASE event_type WHEN 'view' THEN 'book' ELSE 'trade' END AS kind,
  CASE event_type WHEN 'purchase' THEN 'futures' WHEN 'signup' THEN 'options' ELSE 'stock' END AS asset_type, symbol,
  CASE WHEN event_type <> 'view' THEN round({LS_P}, 6) END AS price,
  CASE WHEN event_type <> 'view' THEN event_id::DOUBLE END AS quantity,
  CASE WHEN event_type = 'view' THEN 1 END AS bid_levels, CASE WHEN event_type = 'view' THEN 2 END AS ask_levels,
  CASE WHEN event_type IN ('purchase', 'signup') THEN event_id END AS open_interest,
  CASE event_type WHEN 'purchase' THEN '101' WHEN 'signup' THEN '201' END AS underlying,
  CASE WHEN event_type = 'purchase' THEN 0.25::DOUBLE END AS basis,
  CASE WHEN event_type = 'purchase' THEN round({LS_P} + 1, 6) END AS settlement_price,
  CASE WHEN event_type = 'signup' THEN round({LS_P} + 1, 6) END AS strike_price,
  CASE WHEN event_type = 'signup' THEN 'C' END AS option_type, CASE WHEN event_type = 'signup' THEN 20.5::DOUBLE END AS implied_volatility,
  CASE WHEN event_type = 'signup' THEN -0.1::DOUBLE END AS theta
FROM fx_base WHERE event_type <> 'error'""")
def _(spark, d):
    out = ing.normalize_ls(messages(spark, d, "ls-exchange", LS))
    return out.select(
        "recv_seq", "kind", "asset_type", "symbol", F.round("price", 6).alias("price"), "quantity",
        F.when(F.col("bids").isNotNull(), F.size("bids")).alias("bid_levels"),
        F.when(F.col("asks").isNotNull(), F.size("asks")).alias("ask_levels"), "open_interest", "underlying", "basis",
        F.round("settlement_price", 6).alias("settlement_price"), F.round("strike_price", 6).alias("strike_price"),
        "option_type", "implied_volatility", "theta",
    )


@query("seq_extract", BASE + """
SELECT event_id AS recv_seq, 'binance' AS exchange, CASE WHEN event_type IN ('view', 'signup') THEN event_id END AS update_id,
       CASE WHEN event_type IN ('view', 'signup') THEN event_id END AS first_update_id,
       CASE WHEN event_type = 'view' THEN event_id END AS prev_update_id, event_type = 'signup' AS is_snapshot FROM fx_base
UNION ALL SELECT event_id, 'bybit', CASE WHEN event_type IN ('view', 'signup') THEN event_id END,
       CASE WHEN event_type IN ('view', 'signup') THEN event_id END, NULL, event_type IN ('signup', 'click') FROM fx_base
UNION ALL SELECT event_id, 'okx', CASE WHEN event_type = 'view' THEN event_id END, CASE WHEN event_type = 'view' THEN event_id END,
       CASE WHEN event_type = 'view' THEN event_id END, event_type = 'view' FROM fx_base
UNION ALL SELECT event_id, 'deribit', CASE WHEN event_type = 'view' THEN event_id END, CASE WHEN event_type = 'view' THEN event_id END,
       CASE WHEN event_type = 'view' THEN event_id END, false FROM fx_base""")
def _(spark, d):
    rows = messages(spark, d, "binance", BINANCE)
    for venue, cases in (("bybit", BYBIT), ("okx", OKX), ("deribit", DERIBIT)):
        rows = rows.unionByName(messages(spark, d, venue, cases))
    out = ing.seq_extract(rows)
    return out.select("recv_seq", "exchange", "update_id", "first_update_id", "prev_update_id", "is_snapshot")


@query("parse_text_packets", BASE + """
SELECT event_id, CASE event_type WHEN 'click' THEN 'trade' WHEN 'view' THEN 'orderbook' WHEN 'purchase' THEN 'stats' ELSE 'quarantine' END AS kind,
  CASE WHEN event_type IN ('click', 'view') THEN exchange END AS exchange, CASE WHEN event_type IN ('click', 'view') THEN symbol END AS symbol,
  CASE WHEN event_type IN ('click', 'view') THEN ts_us // 1000 END AS timestamp, CASE WHEN event_type IN ('click', 'view') THEN event_id END AS sequence,
  CASE WHEN event_type = 'purchase' THEN exchange || ',' || k END AS counters FROM fx_base""")
def _(spark, d):
    data = "concat('|{\"exchange\":\"', exchange, '\",\"symbol\":\"', symbol, '\",\"timestamp\":', ts_us div 1000, ',\"sequence\":', event_id, '}')"
    value = F.expr(
        f"CASE event_type WHEN 'click' THEN concat('TRADE', {data}) WHEN 'view' THEN concat('ORDERBOOK', {data}) "
        "WHEN 'purchase' THEN concat('STATS|', exchange, '|', k) WHEN 'signup' THEN 'TRADE|{\"exchange\":' ELSE 'HELLO' END"
    )
    out = ing.parse_text_packets(view(spark, d, "fx_base").select("event_id", value.alias("value")))
    return out.select("event_id", "kind", "exchange", "symbol", "timestamp", "sequence", F.array_join("counters", ",").alias("counters"))


def side_packets(spark, d):
    rows = view(spark, d, "fx_base")
    return rows.select(
        "exchange", "symbol", F.col("event_id").alias("seq"), F.when(F.col("k") % 2 == 0, "bid").otherwise("ask").alias("side"),
        (F.col("cents") % 3 != 0).alias("is_last"), F.array("cents").alias("levels"),
    )


# Packet by packet: the newest list of each side, and both cleared by a last packet that finds both.
SIDES = "WITH RECURSIVE " + duck("fx_base").removeprefix("WITH ") + """,
pk AS MATERIALIZED (SELECT exchange, symbol, event_id AS seq, k % 2 = 0 AS is_bid, cents % 3 <> 0 AS is_last, [cents] AS levels,
  row_number() OVER (PARTITION BY exchange, symbol ORDER BY event_id) AS nth FROM fx_base),
hs AS (
  SELECT exchange, symbol, 0::BIGINT AS nth, 0::BIGINT AS seq, false AS emits, NULL::BIGINT[] AS bids, NULL::BIGINT[] AS asks FROM pk WHERE nth = 1
  UNION ALL
  SELECT p.exchange, p.symbol, p.nth, p.seq, p.is_last AND (p.is_bid OR (NOT h.emits AND h.bids IS NOT NULL)) AND (NOT p.is_bid OR (NOT h.emits AND h.asks IS NOT NULL)),
    CASE WHEN p.is_bid THEN p.levels WHEN NOT h.emits THEN h.bids END, CASE WHEN NOT p.is_bid THEN p.levels WHEN NOT h.emits THEN h.asks END
  FROM hs h JOIN pk p ON p.exchange = h.exchange AND p.symbol = h.symbol AND p.nth = h.nth + 1)
SELECT exchange, symbol, seq, bids, asks FROM hs WHERE emits"""


@query("merge_book_sides", SIDES)
def _(spark, d):
    from tickloom.plans.ordered import chunk_of

    return ing.merge_book_sides(side_packets(spark, d), chunk_of("seq", 1000))


CSV_L2 = duck("fx_l2")


@query("scan_l2_csv", CSV_L2 + """
SELECT symbol, CAST(year(make_timestamp(ts_us)) AS VARCHAR) AS date, count(*) AS rows, round(sum(price), 4) AS price_sum,
       CAST(sum(quantity) AS DOUBLE) AS quantity_sum, count(*) FILTER (is_snapshot) AS snapshot_rows
FROM fx_l2 WHERE symbol IN ('SYM0', 'SYM1') GROUP BY ALL""")
def _(spark, d):
    base = shared_dir(spark, "l2csv")
    rows = view(spark, d, "fx_l2").select(
        "symbol", F.year(F.timestamp_micros("ts_us")).cast("string").alias("date"), F.col("ts_us").alias("timestamp"), "side",
        "price", F.col("quantity").alias("amount"), "is_snapshot",
    )
    rows.write.partitionBy("symbol", "date").option("header", True).option("compression", "gzip").csv(f"{base}/incremental_book_L2")
    out = files.scan_l2_csv(spark, base, symbols=["SYM0", "SYM1"], hive=True)
    return out.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("price"), 4).alias("price_sum"), F.sum("amount").alias("quantity_sum"),
        F.count(F.when(F.col("is_snapshot"), 1)).alias("snapshot_rows"),
    )


@query("scan_trades_csv", duck("fx_trades") + """
SELECT symbol, count(*) AS rows, round(sum(price), 4) AS price_sum, count(*) FILTER (side = 'buy' AND trade_id % 5 <> 0) AS buys,
       count(*) FILTER (trade_id % 4 = 0) AS unknown_ids FROM fx_trades GROUP BY ALL""")
def _(spark, d):
    base = shared_dir(spark, "tradecsv")
    at = F.col("trade_id")
    rows = view(spark, d, "fx_trades").select(
        "symbol", F.lit("2024-01").alias("date"), F.col("ts_us").alias("timestamp"), "price", F.col("quantity").alias("amount"),
        F.when(at % 5 != 0, F.col("side")).alias("side"), F.when(at % 4 != 0, at.cast("string")).alias("id"),
    )
    rows.write.partitionBy("symbol", "date").option("header", True).option("compression", "gzip").csv(f"{base}/trades")
    out = files.scan_trades_csv(spark, base, hive=True)
    return out.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("price"), 4).alias("price_sum"),
        F.count(F.when(F.col("side") == "buy", 1)).alias("buys"), F.count(F.when(F.col("id") == "unknown", 1)).alias("unknown_ids"),
    )


@query("group_l2_rows", CSV_L2 + """
SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY timestamp) AS update FROM (
  SELECT exchange, symbol, ts_us AS timestamp, is_snapshot, count(*) FILTER (side = 'bid') AS bids, count(*) FILTER (side = 'ask') AS asks
  FROM fx_l2 GROUP BY ALL)""")
def _(spark, d):
    from tickloom.plans.ordered import chunk_of

    rows = view(spark, d, "fx_l2").select(
        "exchange", "symbol", F.col("ts_us").alias("timestamp"), "is_snapshot", "side", "price", F.col("quantity").alias("amount"),
        F.concat("side", F.lit(":"), F.col("price_ticks").cast("string")).alias("row"),
    )
    out = files.group_l2_rows(rows, chunk_of("timestamp", 100 * 86_400_000_000), ["exchange", "symbol"])
    return out.select(
        "exchange", "symbol", "timestamp", "is_snapshot", F.size("bids").cast("long").alias("bids"), F.size("asks").cast("long").alias("asks"), "update"
    )


@query("scan_config_symbols", BASE + """
SELECT DISTINCT exchange, CASE event_type WHEN 'click' THEN 'spot' WHEN 'view' THEN 'futures' WHEN 'signup' THEN 'krw' ELSE 'legacy' END AS market,
       symbol FROM fx_base""")
def _(spark, d):
    path = shared_dir(spark, "configs")
    kinds = {"click": "spot_symbols", "view": "futures_symbols", "signup": "krw_symbols"}
    rows = view(spark, d, "fx_base")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("codes"))
    sets = rows.withColumn("kind", kind).groupBy("exchange").agg(
        F.struct(*[F.collect_set(F.when(F.col("kind") == v, F.col("symbol"))).alias(v) for v in (*kinds.values(), "codes")]).alias("subscribe_data")
    )
    sets.write.json(path)
    configs = spark.read.schema("exchange string, " + files.CONFIG_SCHEMA).json(path)
    return ing.scan_config_symbols(configs)


@query("sink_spreads", duck("fx_trades") + """
SELECT symbol, count(*) AS rows, round(sum(round(price % 7, 2)), 4) AS percent_sum FROM fx_trades GROUP BY ALL""")
def _(spark, d):
    path = shared_dir(spark, "spreads")
    rows = view(spark, d, "fx_trades").select("symbol", "ts_us", F.lit("binance").alias("exchange1"), (F.col("price") % 7).alias("spread_percent"))
    files.sink_spreads(rows, path)
    back = spark.read.option("header", True).schema("ts_us long, exchange1 string, spread_percent double, symbol string").csv(path)
    return back.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("spread_percent"), 4).alias("percent_sum"))


@query("sink_ops_tables", duck("fx_ops") + """
SELECT CASE level WHEN 'ERROR' THEN 'error' ELSE 'stats' END AS "table", count(*) AS rows, count(DISTINCT CAST(make_timestamp(ts_us) AS DATE)) AS days,
       max(length('line' || '\\n' || event_id)) AS longest FROM fx_ops GROUP BY ALL""")
def _(spark, d):
    path = shared_dir(spark, "ops")
    rows = view(spark, d, "fx_ops").select(
        F.when(F.col("level") == "ERROR", "error").otherwise("stats").alias("table"), F.timestamp_micros("ts_us").alias("ts"),
        F.concat(F.lit("line\n"), F.col("event_id").cast("string")).alias("message"), "exchange",
    )
    files.sink_ops_tables(rows, path)
    return spark.read.parquet(path).groupBy("table").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("days"), F.max(F.length("message")).cast("long").alias("longest")
    )


@query("sink_market_tables", duck("fx_trades") + """
SELECT exchange, count(*) AS rows, count(DISTINCT CAST(make_timestamp(ts_us) AS DATE)) AS days, round(sum(price), 4) AS price_sum
FROM fx_trades GROUP BY ALL""")
def _(spark, d):
    path = shared_dir(spark, "market")
    rows = view(spark, d, "fx_trades").withColumn("ts", F.timestamp_micros("ts_us"))
    files.sink_market_tables(rows, path)
    return spark.read.parquet(path).groupBy("exchange").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("days"), F.round(F.sum("price"), 4).alias("price_sum")
    )


@query("export_report", duck("fx_options", "fx_realtime") + """
SELECT 'options' AS "table", count(*) AS rows, true AS market_open FROM fx_options
UNION ALL SELECT 'realtime', count(*), true FROM fx_realtime UNION ALL SELECT 'futures', count(*), true FROM supplier""")
def _(spark, d):
    tables = {
        "options": view(spark, d, "fx_options"), "realtime": view(spark, d, "fx_realtime"), "futures": table(spark, d, "supplier"),
    }
    # Monday 2024-01-08 10:30 UTC
    return files.export_report(tables, shared_dir(spark, "report"), 1_704_709_800_000_000)
