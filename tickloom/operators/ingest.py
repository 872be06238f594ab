"""Raw venue messages (JSON text) to one normalised row shape.

Input `raw_messages`: exchange, asset_type, recv_ms, payload (plus any other columns, which
pass through). Every normalizer is one projection: `from_json` with a declared schema,
an array of records, `inline`. Output columns are `RECORD`; `kind` is trade, book or ticker.
Prices and quantities are LONG at 1e8; JSON strings are cut, JSON numbers rounded half up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import scalars as s
from tickloom.operators.folds import complete_books
from tickloom.operators.normalize import map_symbol
from tickloom.plans.ordered import ffill, scan

LEVELS = "array<struct<price_e8:bigint,qty_e8:bigint>>"
RECORD = {
    "kind": "string", "native_symbol": "string", "ts_ms": "bigint", "price_e8": "bigint", "qty_e8": "bigint",
    "side": "string", "trade_id": "string", "is_snapshot": "boolean", "first_update_id": "bigint",
    "update_id": "bigint", "prev_update_id": "bigint", "bids": LEVELS, "asks": LEVELS,
}
TEXT_LEVELS = "array<array<string>>"


def _record(**values: Column) -> Column:
    return F.struct(*[
        (values[name] if name in values else F.lit(None)).cast(kind).alias(name) for name, kind in RECORD.items()
    ])


def _e8(text: Column) -> Column:
    return F.coalesce(s.parse_scaled(text, 8), F.lit(0))


def _num_e8(number: Column) -> Column:
    """JSON number (kept as its text) rounded half up at eight decimals."""
    return (number.try_cast("decimal(28,8)") * F.lit(100_000_000)).try_cast("bigint")


def _levels(pairs: Column, scale=_e8, at: int = 0) -> Column:
    """[[price, quantity, ...], ...] to scaled levels; entries that are too short are dropped."""
    whole = F.filter(F.coalesce(pairs, F.array().cast(TEXT_LEVELS)), lambda x: F.size(x) >= at + 2)
    return F.transform(whole, lambda x: F.struct(
        F.coalesce(scale(x[at]), F.lit(0)).alias("price_e8"), F.coalesce(scale(x[at + 1]), F.lit(0)).alias("qty_e8")
    ))


def _ms(text: Column) -> Column:
    value = text.try_cast("bigint")
    return F.when(value < 0, F.lit(0)).otherwise(value)


def _iso_ms(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def _emit(df: DataFrame, records: Column, dim_symbol: DataFrame | None, on_missing: str) -> DataFrame:
    rest = [c for c in df.columns if c not in ("payload", "_m", "_d", "_k", "stream")]
    out = df.select(*rest, F.inline(records))
    out = out.filter(F.coalesce(F.col("native_symbol"), F.lit("")) != "")
    if dim_symbol is None:
        return out.withColumn("symbol", F.col("native_symbol"))
    return map_symbol(out, dim_symbol, on_missing)


def _one(condition: Column, record: Column) -> Column:
    return F.when(condition, F.array(record)).otherwise(F.array().cast(_array_type()))


def _many(condition: Column, records: Column) -> Column:
    empty = F.array().cast(_array_type())
    return F.when(condition & records.isNotNull(), records).otherwise(empty)


def _array_type() -> str:
    return "array<struct<" + ",".join(f"{n}:{k}" for n, k in RECORD.items()) + ">>"


def _json(df: DataFrame, **schemas: str) -> DataFrame:
    """Parse the payload under one or more schemas; a field of another type is NULL in that parse."""
    return df.withColumn("_m", F.struct(*[F.from_json("payload", t).alias(n) for n, t in schemas.items()]))


def normalize_binance(df: DataFrame, dim_symbol: DataFrame | None = None) -> DataFrame:
    # keys differ only by case (u / U, e / E), so messages are read as maps from key to raw text
    keys = "map<string,string>"
    rows = df.withColumn("_m", F.from_json("payload", keys)).withColumns({
        "_d": F.coalesce(F.from_json(F.try_element_at("_m", F.lit("data")), keys), F.col("_m")),
        "stream": F.coalesce(F.try_element_at("_m", F.lit("stream")), F.lit("")),
    })

    def g(name: str) -> Column:
        return F.try_element_at("_d", F.lit(name))

    def arr(*names: str) -> Column:
        return F.from_json(F.coalesce(*[g(n) for n in names]), TEXT_LEVELS)

    has_sides = (g("b").isNotNull() & g("a").isNotNull()) | (g("bids").isNotNull() & g("asks").isNotNull())
    kind = (
        F.when(F.col("stream").contains("@trade"), "trade").when(F.col("stream").contains("@depth"), "book")
        .when(g("e") == "trade", "trade").when(has_sides, "book")
    )
    now = F.col("recv_ms")
    traded = g("T").try_cast("bigint")
    ts = F.when(s.is_timestamp(traded, now), s.to_millis(traded, s.unit_of_digits(s.digits_of(traded)))).otherwise(now)
    trade = _record(
        kind=F.lit("trade"), native_symbol=g("s"), ts_ms=ts, price_e8=_e8(g("p")), qty_e8=_e8(g("q")),
        side=F.when(g("m") == "true", "sell").when(g("m") == "false", "buy"), trade_id=g("t"),
    )
    streamed = F.upper(F.substring_index("stream", "@", 1))
    final = F.coalesce(g("u"), g("lastUpdateId")).try_cast("bigint")
    book = _record(
        kind=F.lit("book"), native_symbol=F.when(F.col("stream") != "", streamed).otherwise(g("s")),
        ts_ms=F.coalesce(_ms(g("E")), now), is_snapshot=g("lastUpdateId").isNotNull(),
        first_update_id=F.coalesce(g("U").try_cast("bigint"), final), update_id=final,
        prev_update_id=g("pu").try_cast("bigint"), bids=_levels(arr("b", "bids")), asks=_levels(arr("a", "asks")),
    )
    rows = rows.withColumn("_k", kind)
    records = F.concat(_one(F.col("_k") == "trade", trade), _one((F.col("_k") == "book") & F.coalesce(g("b"), g("bids")).isNotNull(), book))
    return _emit(rows, records, dim_symbol, "drop")


def normalize_bybit(df: DataFrame, dim_symbol: DataFrame | None = None) -> DataFrame:
    trade = "map<string,string>"  # s is the symbol and S the side
    rows = _json(
        df,
        many=f"topic string, data array<{trade}>",
        one=f"topic string, type string, ts string, cts string, data struct<s:string,type:string,b:{TEXT_LEVELS},a:{TEXT_LEVELS},u:bigint,seq:bigint>",
    )
    many, one = F.col("_m.many"), F.col("_m.one")
    single = F.from_json(F.get_json_object("payload", "$.data"), trade)
    listed = F.coalesce(many["data"], F.array(single))
    now = F.col("recv_ms")

    def as_trade(entry: Column) -> Column:
        t = {name: F.try_element_at(entry, F.lit(name)) for name in ("T", "s", "S", "v", "p", "i")}
        at = t["T"].try_cast("bigint")
        ts = F.when(s.is_timestamp(at, now), s.to_millis(at, s.unit_of_digits(s.digits_of(at)))).otherwise(now)
        return _record(
            kind=F.lit("trade"), native_symbol=t["s"], ts_ms=ts, price_e8=_e8(t["p"]), qty_e8=_e8(t["v"]),
            side=F.lower(t["S"]), trade_id=t["i"],
        )

    stamp = F.coalesce(_ms(F.get_json_object("payload", "$.data.T")), _ms(one["ts"]), _ms(one["cts"]), F.lit(0))
    book = _record(
        kind=F.lit("book"), native_symbol=one["data"]["s"], ts_ms=stamp,
        is_snapshot=F.coalesce(one["type"], one["data"]["type"]) == "snapshot", update_id=one["data"]["u"],
        first_update_id=one["data"]["u"], bids=_levels(one["data"]["b"]), asks=_levels(one["data"]["a"]),
    )
    topic = F.coalesce(one["topic"], many["topic"], F.lit(""))
    records = F.concat(
        _many(topic.startswith("publicTrade"), F.transform(listed, as_trade)), _one(topic.startswith("orderbook"), book)
    )
    return _emit(rows, records, dim_symbol, "keep")


def normalize_okx(df: DataFrame, dim_symbol: DataFrame | None = None) -> DataFrame:
    rows = _json(df, m=(
        "arg struct<channel:string,instId:string>, data array<struct<px:string,sz:string,ts:string,side:string,"
        f"tradeId:string,bids:{TEXT_LEVELS},asks:{TEXT_LEVELS},seqId:string,prevSeqId:string>>"
    ))
    m = F.col("_m.m")
    inst = m["arg"]["instId"]

    def stamp(x: Column) -> Column:
        return F.coalesce(_ms(x["ts"]), F.col("recv_ms"))

    def as_trade(x: Column) -> Column:
        return _record(
            kind=F.lit("trade"), native_symbol=inst, ts_ms=stamp(x), price_e8=_e8(x["px"]), qty_e8=_e8(x["sz"]),
            side=x["side"], trade_id=x["tradeId"],
        )

    def as_book(x: Column) -> Column:
        return _record(
            kind=F.lit("book"), native_symbol=inst, ts_ms=stamp(x), is_snapshot=F.lit(True),
            update_id=x["seqId"].try_cast("bigint"), first_update_id=x["seqId"].try_cast("bigint"),
            prev_update_id=x["prevSeqId"].try_cast("bigint"), bids=_levels(x["bids"]), asks=_levels(x["asks"]),
        )

    channel = F.coalesce(m["arg"]["channel"], F.lit(""))
    records = F.concat(
        _many(channel == "trades", F.transform(m["data"], as_trade)),
        _many(channel == "books5", F.transform(m["data"], as_book)),
    )
    return _emit(rows, records, dim_symbol, "keep")


def normalize_coinbase(df: DataFrame, dim_symbol: DataFrame | None = None) -> DataFrame:
    rows = _json(df, m=(
        "channel string, timestamp string, type string, product_id string, price string, last_size string, time string,"
        " sequence_num bigint,"
        f" bids {TEXT_LEVELS}, asks {TEXT_LEVELS}, changes {TEXT_LEVELS},"
        " events array<struct<type:string,product_id:string,"
        "trades:array<struct<product_id:string,price:string,size:string,time:string,side:string,trade_id:string>>,"
        "updates:array<struct<side:string,event_time:string,price_level:string,new_quantity:string>>>>"
    ))
    m = F.col("_m.m")
    channel, kind = F.coalesce(m["channel"], F.lit("")), F.coalesce(m["type"], F.lit(""))

    def as_trade(t: Column) -> Column:
        return _record(
            kind=F.lit("trade"), native_symbol=t["product_id"], ts_ms=F.coalesce(_iso_ms(t["time"]), F.lit(0)),
            price_e8=_e8(t["price"]), qty_e8=_e8(t["size"]), side=F.lower(t["side"]), trade_id=t["trade_id"],
        )

    def level(price: Column, quantity: Column) -> Column:
        return F.struct(_e8(price).alias("price_e8"), _e8(quantity).alias("qty_e8"))

    def as_book(event: Column) -> Column:
        def side(name: str) -> Column:
            mine = F.filter(event["updates"], lambda u: u["side"] == name)
            return F.transform(mine, lambda u: level(u["price_level"], u["new_quantity"]))

        at = F.coalesce(_iso_ms(F.get(event["updates"], 0)["event_time"]), _iso_ms(m["timestamp"]), F.col("recv_ms"))
        return _record(
            kind=F.lit("book"), native_symbol=event["product_id"], ts_ms=at, is_snapshot=event["type"] == "snapshot",
            bids=side("bid"), asks=side("ask"), update_id=m["sequence_num"],
        )

    booked = F.filter(m["events"], lambda e: e["type"].isin("snapshot", "update"))
    at = F.coalesce(_iso_ms(m["time"]), F.col("recv_ms"))
    changes = F.filter(F.coalesce(m["changes"], F.array().cast(TEXT_LEVELS)), lambda c: F.size(c) == 3)
    ticker = _record(
        kind=F.lit("trade"), native_symbol=m["product_id"], ts_ms=F.coalesce(_iso_ms(m["time"]), F.lit(0)),
        price_e8=_e8(m["price"]), qty_e8=_e8(m["last_size"]),
    )
    full = _record(
        kind=F.lit("book"), native_symbol=m["product_id"], ts_ms=at, is_snapshot=F.lit(True), bids=_levels(m["bids"]),
        asks=_levels(m["asks"]),
    )
    update = _record(
        kind=F.lit("book"), native_symbol=m["product_id"], ts_ms=at, is_snapshot=F.lit(False),
        bids=F.transform(F.filter(changes, lambda c: c[0] == "buy"), lambda c: level(c[1], c[2])),
        asks=F.transform(F.filter(changes, lambda c: c[0] != "buy"), lambda c: level(c[1], c[2])),
    )
    legacy = ~channel.isin("market_trades", "l2_data")
    records = F.concat(
        _many(channel == "market_trades", F.transform(F.flatten(F.transform(m["events"], lambda e: e["trades"])), as_trade)),
        _many(channel == "l2_data", F.transform(booked, as_book)),
        _one(legacy & (kind == "ticker"), ticker), _one(legacy & (kind == "snapshot"), full),
        _one(legacy & (kind == "l2update"), update),
    )
    return _emit(rows, records, dim_symbol, "keep")


def normalize_deribit(df: DataFrame, dim_symbol: DataFrame | None = None) -> DataFrame:
    """Trades, books of [action, price, amount] triples, and tickers kept apart from trades."""
    trade = "instrument_name:string,price:string,amount:string,timestamp:string,direction:string,trade_id:string"
    rows = _json(
        df,
        many=f"method string, params struct<channel:string,data:array<struct<{trade}>>>",
        one=("method string, params struct<channel:string,data:struct<instrument_name:string,timestamp:string,"
             f"last_price:string,stats:struct<volume:string>,type:string,change_id:bigint,prev_change_id:bigint,"
             f"bids:{TEXT_LEVELS},asks:{TEXT_LEVELS}>>"),
    )
    many, one = F.col("_m.many"), F.col("_m.one")
    data = one["params"]["data"]
    channel = F.coalesce(one["params"]["channel"], many["params"]["channel"], F.lit(""))
    live = F.coalesce(one["method"], many["method"]) == "subscription"

    def stamp(x: Column) -> Column:
        return F.coalesce(_ms(x["timestamp"]), F.lit(0))

    def as_trade(t: Column) -> Column:
        return _record(
            kind=F.lit("trade"), native_symbol=t["instrument_name"], ts_ms=stamp(t),
            price_e8=F.coalesce(_num_e8(t["price"]), F.lit(0)), qty_e8=F.coalesce(_num_e8(t["amount"]), F.lit(0)),
            side=t["direction"], trade_id=t["trade_id"],
        )

    def triples(side: Column) -> Column:
        whole = F.filter(F.coalesce(side, F.array().cast(TEXT_LEVELS)), lambda x: F.size(x) == 3)
        return F.transform(whole, lambda x: F.struct(
            F.coalesce(_num_e8(x[1]), F.lit(0)).alias("price_e8"),
            F.when(x[0] == "delete", F.lit(0)).otherwise(F.coalesce(_num_e8(x[2]), F.lit(0))).alias("qty_e8"),
        ))

    ticker = _record(
        kind=F.lit("ticker"), native_symbol=data["instrument_name"], ts_ms=stamp(data),
        price_e8=_num_e8(data["last_price"]), qty_e8=F.coalesce(_num_e8(data["stats"]["volume"]), F.lit(0)),
    )
    book = _record(
        kind=F.lit("book"), native_symbol=data["instrument_name"], ts_ms=stamp(data), is_snapshot=data["type"] == "snapshot",
        update_id=data["change_id"], first_update_id=data["change_id"], prev_update_id=data["prev_change_id"],
        bids=triples(data["bids"]), asks=triples(data["asks"]),
    )
    records = F.concat(
        _many(live & channel.startswith("trades"), F.transform(many["params"]["data"], as_trade)),
        _one(live & channel.startswith("ticker") & data["last_price"].isNotNull(), ticker),
        _one(live & channel.startswith("book"), book),
    )
    return _emit(rows, records, dim_symbol, "keep")


_UNITS = "array<struct<ask_price:string,bid_price:string,ask_size:string,bid_size:string>>"


def _unit_side(units: Column, side: str) -> Column:
    whole = F.filter(units, lambda u: u[f"{side}_price"].isNotNull() & u[f"{side}_size"].isNotNull())
    return F.transform(whole, lambda u: F.struct(
        _num_e8(u[f"{side}_price"]).alias("price_e8"), _num_e8(u[f"{side}_size"]).alias("qty_e8")
    ))


def normalize_upbit(df: DataFrame, dim_symbol: DataFrame | None = None) -> DataFrame:
    rows = _json(df, m=(
        "type string, code string, trade_price string, trade_volume string, trade_timestamp string, ask_bid string,"
        f" sequential_id string, timestamp string, orderbook_units {_UNITS}"
    ))
    m = F.col("_m.m")
    trade = _record(
        kind=F.lit("trade"), native_symbol=m["code"], ts_ms=F.coalesce(_ms(m["trade_timestamp"]), F.lit(0)),
        price_e8=F.coalesce(_num_e8(m["trade_price"]), F.lit(0)), qty_e8=F.coalesce(_num_e8(m["trade_volume"]), F.lit(0)),
        side=F.when(m["ask_bid"] == "BID", "buy").when(m["ask_bid"] == "ASK", "sell"), trade_id=m["sequential_id"],
    )
    book = _record(
        kind=F.lit("book"), native_symbol=m["code"], ts_ms=F.coalesce(_ms(m["timestamp"]), F.col("recv_ms")),
        is_snapshot=F.lit(True), bids=_unit_side(m["orderbook_units"], "bid"), asks=_unit_side(m["orderbook_units"], "ask"),
    )
    records = F.concat(
        _one(m["type"] == "trade", trade), _one((m["type"] == "orderbook") & m["orderbook_units"].isNotNull(), book)
    )
    return _emit(rows, records, dim_symbol, "drop")


def normalize_bithumb(df: DataFrame, dim_symbol: DataFrame | None = None, depth: int = 20) -> DataFrame:
    """Long and short key spellings; a trade without volume counts as 1.0."""
    rows = _json(df, m=(
        "type string, code string, cd string, trade_price string, tp string, trade_volume string, tv string,"
        f" trade_timestamp string, ttms string, timestamp string, ask_bid string, ab string, orderbook_units {_UNITS}"
    ))
    m = F.col("_m.m")
    side = F.coalesce(m["ask_bid"], m["ab"])
    trade = _record(
        kind=F.lit("trade"), native_symbol=F.coalesce(m["code"], m["cd"]),
        ts_ms=F.coalesce(_ms(F.coalesce(m["trade_timestamp"], m["ttms"], m["timestamp"])), F.col("recv_ms")),
        price_e8=F.coalesce(_num_e8(F.coalesce(m["trade_price"], m["tp"])), F.lit(0)),
        qty_e8=F.coalesce(_num_e8(F.coalesce(m["trade_volume"], m["tv"])), F.lit(100_000_000)),
        side=F.when(side == "BID", "buy").when(side == "ASK", "sell"),
    )
    units = F.slice(m["orderbook_units"], 1, depth)
    book = _record(
        kind=F.lit("book"), native_symbol=m["code"], ts_ms=F.coalesce(_ms(m["timestamp"]), F.col("recv_ms")),
        is_snapshot=F.lit(True), bids=_unit_side(units, "bid"), asks=_unit_side(units, "ask"),
    )
    records = F.concat(
        _one(m["type"] == "trade", trade), _one((m["type"] == "orderbook") & m["orderbook_units"].isNotNull(), book)
    )
    return _emit(rows, records, dim_symbol, "drop")


# Message code prefixes of the Korean broker feed and what they carry.
LS_CODES = {
    "S3_": ("trade", "stock"), "H1_": ("book", "stock"), "FC_": ("trade", "futures"), "FH_": ("book", "futures"),
    "FO_": ("open_interest", "futures"), "OC_": ("trade", "options"), "OH_": ("book", "options"),
    "OO_": ("open_interest", "options"), "OF_": ("trade", "overseas_futures"),
}
_LS_NUMBERS = (
    "price", "cvolume", "volume", "openinterest", "basis", "settlement", "actprice", "impvol", "delta", "gamma", "theta",
    "vega", "rho",
)
_LS_TEXTS = ("shcode", "futcode", "optcode", "symbol", "basecode", "lastdate", "opttype")


def normalize_ls(df: DataFrame, levels: int = 10) -> DataFrame:
    """Broker messages by code prefix; derivatives fields are NULL where a message has none.

    `levels=1` reads the basic feed with unnumbered quote fields (bidho / offerho).
    """
    names = [
        f"{side}{what}{i if levels > 1 else ''}" for side in ("bid", "offer") for what in ("ho", "rem")
        for i in range(1, levels + 1)
    ]
    body = ",".join([f"{c}:string" for c in _LS_TEXTS] + [f"{c}:double" for c in (*_LS_NUMBERS, *names)])
    rows = _json(df, m=f"header struct<tr_cd:string>, body struct<{body}>")
    m = F.col("_m.m")
    b = m["body"]
    prefix = F.substring(m["header"]["tr_cd"], 1, 3)
    table = {k: F.create_map(*[F.lit(x) for p, v in LS_CODES.items() for x in (p, v[k])]) for k in (0, 1)}
    kind, asset = table[0][prefix], table[1][prefix]

    def side(name: str) -> Column:
        tags = [str(i) if levels > 1 else "" for i in range(1, levels + 1)]
        every = F.array(*[F.struct(b[f"{name}ho{t}"].alias("price"), b[f"{name}rem{t}"].alias("quantity")) for t in tags])
        return F.filter(every, lambda lv: (lv["price"] > 0) & lv["quantity"].isNotNull())

    code = F.when(asset == "overseas_futures", b["symbol"]).when(kind == "book", b["shcode"]).when(
        asset == "futures", b["futcode"]).when(asset == "options", b["optcode"]).otherwise(b["shcode"])
    zero = F.lit(0.0)
    quantity = F.coalesce(F.when(asset == "stock", b["cvolume"]).otherwise(b["volume"]), zero)
    option = (asset == "options") & (kind == "trade")
    future = (asset == "futures") & (kind == "trade")
    rest = [c for c in df.columns if c not in ("payload", "asset_type")]
    return rows.filter(kind.isNotNull() & b.isNotNull()).select(
        *rest, kind.alias("kind"), asset.alias("asset_type"), code.alias("symbol"), F.col("recv_ms").alias("ts_ms"),
        F.when(kind == "trade", F.coalesce(b["price"], zero)).alias("price"),
        F.when(kind == "trade", quantity).alias("quantity"),
        F.when(kind == "book", side("bid")).alias("bids"), F.when(kind == "book", side("offer")).alias("asks"),
        F.when(asset.isin("futures", "options") & (kind != "book"), F.coalesce(b["openinterest"], zero).cast("long")).alias("open_interest"),
        F.when(future | option, b["basecode"]).alias("underlying"), F.when(future | option, b["lastdate"]).alias("expiry_date"),
        F.when(future, F.coalesce(b["basis"], zero)).alias("basis"),
        F.when(future, F.coalesce(b["settlement"], zero)).alias("settlement_price"),
        F.when(option, F.coalesce(b["actprice"], zero)).alias("strike_price"),
        F.when(option, F.when(b["opttype"] == "C", "C").otherwise("P")).alias("option_type"),
        F.when(option, F.coalesce(b["impvol"], zero)).alias("implied_volatility"),
        *[F.when(option, F.coalesce(b[g], zero)).alias(g) for g in ("delta", "gamma", "theta", "vega", "rho")],
    )


def seq_extract(df: DataFrame) -> DataFrame:
    """Sequence fields of a message per venue, without the rest of it; numbers may be text."""
    def g(path: str) -> Column:
        return F.get_json_object("payload", f"$.{path}").try_cast("bigint")

    rest = g("lastUpdateId")
    by_venue = {
        "binance": (F.coalesce(rest, g("u"), g("data.u")), F.coalesce(rest, g("U"), g("data.U")), F.coalesce(g("pu"), g("data.pu"))),
        "bybit": (F.coalesce(g("data.u"), g("data.seq")), F.coalesce(g("data.u"), g("data.seq")), None),
        "okx": (g("data[0].seqId"), g("data[0].seqId"), g("data[0].prevSeqId")),
        "coinbase": (g("sequence_num"), g("sequence_num"), None),
        "deribit": (g("params.data.change_id"), g("params.data.change_id"), g("params.data.prev_change_id")),
    }
    kind = F.coalesce(F.get_json_object("payload", "$.type"), F.get_json_object("payload", "$.data.type"),
                      F.get_json_object("payload", "$.params.data.type"))
    snapshot = F.when(F.col("exchange") == "binance", rest.isNotNull()).when(
        F.col("exchange") == "okx", F.get_json_object("payload", "$.arg.channel") == "books5"
    ).otherwise(kind == "snapshot")
    none = F.lit(None).cast("bigint")

    def pick(at: int) -> Column:
        out = none
        for venue, fields in by_venue.items():
            out = F.when(F.col("exchange") == venue, fields[at] if fields[at] is not None else none).otherwise(out)
        return out

    return df.withColumns({
        "update_id": pick(0), "first_update_id": pick(1), "prev_update_id": pick(2),
        "is_snapshot": F.coalesce(snapshot, F.lit(False)),
    })


TEXT_KINDS = ("TRADE", "ORDERBOOK", "EXCHANGE", "CONN", "STATS")


def parse_text_packets(df: DataFrame) -> DataFrame:
    """`KIND|{json}` and `KIND|a|b|...` lines to typed rows; what cannot be read is kind `quarantine`."""
    parts = F.split("value", r"\|", 2)
    rows = df.withColumns({"_k": parts[0], "_body": F.get(parts, 1)})
    body = F.from_json("_body", "exchange string, symbol string, timestamp bigint, sequence bigint, price double, quantity double, _bad string",
                       {"columnNameOfCorruptRecord": "_bad"})
    rows = rows.withColumn("_j", body)
    data = F.col("_k").isin("TRADE", "ORDERBOOK")
    good = data & F.col("_j").isNotNull() & F.col("_j._bad").isNull() & F.col("_j.exchange").isNotNull()
    counters = F.col("_k").isin(*TEXT_KINDS[2:]) & F.col("_body").isNotNull()
    return rows.select(
        *df.columns, F.when(good | counters, F.lower("_k")).otherwise("quarantine").alias("kind"),
        *[F.when(good, F.col(f"_j.{c}")).alias(c) for c in ("exchange", "symbol", "timestamp", "sequence", "price", "quantity")],
        F.when(counters, F.split("_body", r"\|")).alias("counters"),
    )


def merge_book_sides(packets: DataFrame, chunk: Column, keys: tuple[str, ...] = ("exchange", "symbol")) -> DataFrame:
    """One book per `is_last` row at which both sides are held; the book clears both.

    Input rows: seq, side, is_last, levels. The newest list of each side wins.
    """
    k = list(keys)
    marked = complete_books(packets.select(*k, "seq", "side", "is_last"), k, chunk, ["seq"]).filter("emits")
    held = scan(
        packets, k, ["seq"], chunk,
        bids=ffill(F.when(F.col("side") == "bid", F.col("levels"))), asks=ffill(F.when(F.col("side") == "ask", F.col("levels"))),
    )
    return held.filter("is_last").select(*k, "seq", "bids", "asks").join(marked.select(*k, "seq"), [*k, "seq"])


def scan_config_symbols(config: DataFrame) -> DataFrame:
    """(exchange, market, symbol) of subscription configs, de-duplicated over all their lists.

    `config`: one row per file with exchange and subscribe_data as read by `sources.files`.
    """
    lists = {"spot_symbols": "spot", "futures_symbols": "futures", "krw_symbols": "krw", "codes": "legacy"}
    out = None
    for field, market in lists.items():
        rows = config.select("exchange", F.lit(market).alias("market"), F.explode(f"subscribe_data.{field}").alias("symbol"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()
