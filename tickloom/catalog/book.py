"""Book reconstruction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import last_accepted, query
from tickloom.operators import book as b
from tickloom.operators.builder import builder_states
from tickloom.operators.replay import replayed
from tickloom.session import stored
from tickloom.sources.fixtures import duck, view

KEY = ["exchange", "symbol"]
CHUNK = 100  # seq is a day number in the fixture

MSG = """SELECT exchange, symbol, seq, max(ts_us) AS ts_us, max(update_id) AS update_id, bool_or(is_snapshot) AS is_snapshot
  FROM fx_l2 GROUP BY exchange, symbol, seq"""
EPOCHED = """SELECT *, max(CASE WHEN is_snapshot THEN seq END) OVER (PARTITION BY exchange, symbol ORDER BY seq) AS epoch,
    min(CASE WHEN is_snapshot THEN seq END) OVER (PARTITION BY exchange, symbol ORDER BY seq
      RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_epoch FROM fx_l2"""
IVALS = """SELECT exchange, symbol, side, price_ticks, price, quantity, seq AS seq_from, next_epoch, least(
    coalesce(lead(seq) OVER (PARTITION BY exchange, symbol, side, price_ticks ORDER BY seq), 1000000),
    coalesce(next_epoch, 1000000)) AS seq_to FROM ep WHERE epoch IS NOT NULL"""
# A message whose book is empty keeps one row, with a NULL side.
LV = """SELECT m.exchange, m.symbol, m.seq, m.ts_us, i.side, i.price_ticks, i.price, i.quantity,
    row_number() OVER (PARTITION BY m.exchange, m.symbol, m.seq, i.side
      ORDER BY CASE i.side WHEN 'bid' THEN -i.price_ticks ELSE i.price_ticks END) AS rk
  FROM (SELECT *, min(CASE WHEN is_snapshot THEN seq END) OVER (PARTITION BY exchange, symbol) AS begun FROM msg) m
  LEFT JOIN iv i ON m.exchange = i.exchange AND m.symbol = i.symbol AND i.seq_from <= m.seq AND m.seq < i.seq_to AND i.quantity > 0
  WHERE m.seq >= m.begun"""
L2 = duck("fx_l2", extra={"msg": MSG, "ep": EPOCHED, "iv": IVALS})
BOOK = duck("fx_l2", extra={"msg": MSG, "ep": EPOCHED, "iv": IVALS, "lv": LV})

# First days of each month of the ship-date range, as day numbers and as timestamps.
# the last point is later than every row
MONTHS = """SELECT DISTINCT CAST(datediff('day', DATE '1995-01-01', date_trunc('month', l_shipdate)) AS BIGINT) AS at FROM lineitem
UNION ALL SELECT CAST(datediff('day', DATE '1995-01-01', date_trunc('month', max(l_shipdate)) + INTERVAL 2 MONTH) AS BIGINT) FROM lineitem"""


def levels(spark, d):
    return view(spark, d, "fx_l2")


def stored_levels(spark, d):
    """For queries whose parts would each aggregate the table again."""
    return stored(levels(spark, d), "levels")


def month_points(spark, d):
    """(exchange, symbol, at) for the first day of each month and every key, and one point later than every row."""
    last = levels(spark, d).agg(F.trunc(F.timestamp_micros(F.max("ts_us")), "month")).scalar()
    span = levels(spark, d).groupBy(*KEY).agg(F.trunc(F.timestamp_micros(F.min("ts_us")), "month").alias("first")).withColumn("last", last)
    months = F.explode(F.expr("concat(sequence(first, last, interval 1 month), array(add_months(last, 2)))"))
    return span.select(*KEY, months.alias("day")).select(
        *KEY, F.datediff("day", F.lit("1995-01-01")).cast("long").alias("at"))


def _pick(at: str, extra: str = "") -> str:
    return f"""
SELECT p.exchange, p.symbol, p.at, i.side, i.price_ticks, i.price, i.quantity
FROM (SELECT k.exchange, k.symbol, m.at FROM (SELECT DISTINCT exchange, symbol FROM fx_l2) k CROSS JOIN ({MONTHS}) m) p
JOIN {at} i ON p.exchange = i.exchange AND p.symbol = i.symbol AND i.seq_from <= p.at AND p.at < i.seq_to
 AND i.quantity > 0 {extra}"""


@query("book_levels_at", L2 + _pick("iv"))
def _(spark, d):
    return b.book_levels_at(levels(spark, d), month_points(spark, d), CHUNK, bucket=30)


ACT = duck("fx_l2", extra={"ia": """SELECT exchange, symbol, side, price_ticks, price, quantity, seq AS seq_from,
    coalesce(lead(seq) OVER (PARTITION BY exchange, symbol, side, price_ticks ORDER BY seq), 1000000) AS seq_to
    FROM fx_l2"""})


@query("book_levels_actions", ACT + _pick("ia"))
def _(spark, d):
    actions = levels(spark, d).withColumn(
        "action", F.when(F.col("quantity") == 0, "delete").otherwise("change")
    ).withColumn("quantity", F.when(F.col("quantity") == 0, F.lit(1.0)).otherwise(F.col("quantity")))
    return b.book_levels_actions(actions, month_points(spark, d), CHUNK, bucket=30)


SUMMARY = """
SELECT exchange, symbol, seq, count(*) FILTER (side = 'bid') AS bid_levels, count(*) FILTER (side = 'ask') AS ask_levels,
       coalesce(sum(quantity) FILTER (side = 'bid'), 0) AS bid_qty, coalesce(sum(quantity) FILTER (side = 'ask'), 0) AS ask_qty
"""


def summary(df, *more):
    def q(side):
        return F.aggregate(side, F.lit(0.0), lambda acc, lv: acc + lv["quantity"])

    return df.select(
        "exchange", "symbol", "seq", F.size("bids").cast("long").alias("bid_levels"),
        F.size("asks").cast("long").alias("ask_levels"), q("bids").alias("bid_qty"), q("asks").alias("ask_qty"), *more,
    )


@query("book_snapshots_series", BOOK + """, nth AS (
  SELECT exchange, symbol, seq FROM (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY seq) AS n FROM msg)
  WHERE n % 100 = 0)""" + SUMMARY + "FROM lv SEMI JOIN nth USING (exchange, symbol, seq) GROUP BY ALL")
def _(spark, d):
    return summary(b.book_snapshots_series(levels(spark, d), CHUNK, 100))


@query("book_snapshots", BOOK + """, nth AS (
  SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY seq DESC) AS back FROM (
    SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY seq) AS n FROM msg) WHERE n % 50 = 0)"""
       + SUMMARY + """, max(n) AS nth FROM lv JOIN (SELECT exchange, symbol, seq, n FROM nth WHERE back <= 10)
  USING (exchange, symbol, seq) GROUP BY ALL""")
def _(spark, d):
    return summary(b.book_snapshots(levels(spark, d), CHUNK, 50, 10), "nth")


@query("restored_books", BOOK + """, nth AS (
  SELECT exchange, symbol, max(seq) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY seq) AS n FROM msg) WHERE n % 50 = 0 GROUP BY ALL)"""
       + SUMMARY + "FROM lv JOIN nth USING (exchange, symbol) WHERE seq >= kept GROUP BY ALL")
def _(spark, d):
    lv = stored_levels(spark, d)
    return summary(b.restored_books(b.book_snapshots(lv, CHUNK, 50, 10), lv, CHUNK))


@query("seq_gaps", L2 + """
SELECT exchange, symbol, seq, is_snapshot, last_id, has_gap, CASE WHEN has_gap THEN update_id - last_id - 1 ELSE 0 END AS missing
FROM (SELECT *, coalesce(NOT is_snapshot AND update_id <> last_id + 1, false) AS has_gap FROM (
  SELECT *, lag(update_id) OVER (PARTITION BY exchange, symbol ORDER BY seq) AS last_id FROM msg))""")
def _(spark, d):
    out = b.seq_gaps(b.messages(levels(spark, d)), CHUNK)
    return out.select("exchange", "symbol", "seq", "is_snapshot", "last_id", "has_gap", "missing")


CHAIN = """, c AS (SELECT *, CASE WHEN update_id % 13 = 0 THEN update_id - 2 ELSE
    lag(update_id) OVER (PARTITION BY exchange, symbol ORDER BY seq) END AS pu FROM msg),
k AS (SELECT *, max(CASE WHEN is_snapshot THEN seq END) OVER w AS epoch,
    coalesce(NOT is_snapshot AND lag(update_id) OVER w <> pu, false) AS bad FROM c
    WINDOW w AS (PARTITION BY exchange, symbol ORDER BY seq))"""


def _chained(spark, d):
    from tickloom.plans.ordered import chunk_of, prev, scan

    rows = scan(b.messages(levels(spark, d)), KEY, ["seq"], chunk_of("seq", CHUNK), _p=prev(F.col("update_id")))
    pu = F.when(F.col("update_id") % 13 == 0, F.col("update_id") - 2).otherwise(F.col("_p"))
    return rows.withColumn("prev_update_id", pu).drop("_p")


@query("pu_chain", L2 + CHAIN + """
SELECT exchange, symbol, seq, epoch, NOT bad AS in_chain, epoch IS NOT NULL AND NOT coalesce(bool_or(bad) OVER (
    PARTITION BY exchange, symbol, epoch ORDER BY seq), false) AS synchronised FROM k""")
def _(spark, d):
    out = b.pu_chain(_chained(spark, d), CHUNK)
    return out.select("exchange", "symbol", "seq", "epoch", "in_chain", "synchronised")


DAY_US = 86_400_000_000
TIMEOUT, BACKOFF, REST, ATTEMPTS, BUFFER = 6 * DAY_US, DAY_US, 5 * DAY_US, 2, 4

# One step at a time: a timer that has run out by the next message, else that message.
def builder_sql(wrong: str, timeout: int = TIMEOUT, backoff: int = BACKOFF, rest: int = REST, attempts: int = ATTEMPTS) -> str:
    """Table `st`: one row per step of a builder over the messages `msg`; `wrong` says what is wrong with a message, or NULL."""
    return f"""
, ms AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY seq) AS nth, {wrong} AS wrong FROM msg),
st AS (
  SELECT exchange, symbol, 0 AS nth, NULL::VARCHAR AS kind, NULL::VARCHAR AS met, 'buffering' AS mode, 'initial' AS reason, 0 AS attempt, ts_us AS since, ts_us AS cycle,
         NULL::BIGINT AS last_id, 0 AS applied, 0 AS gaps, 0 AS resyncs, 0 AS ok, 0 AS failed, 0 AS n FROM ms WHERE nth = 1
  UNION ALL
  SELECT exchange, symbol, CASE WHEN due <= ts_us THEN nth ELSE nth + 1 END, kind, mode,
    CASE WHEN trouble IS NOT NULL THEN CASE WHEN used >= {attempts} THEN 'error' ELSE 'resync' END WHEN kind IN ('resync', 'error') THEN 'buffering'
         WHEN kind IN ('snap', 'apply') THEN 'live' ELSE mode END,
    CASE WHEN trouble IS NOT NULL THEN trouble WHEN kind = 'error' THEN 'initial' WHEN kind = 'snap' THEN NULL ELSE reason END,
    used + (trouble IS NOT NULL)::INT, CASE WHEN trouble IS NOT NULL OR kind IN ('resync', 'error', 'snap') THEN moment ELSE since END,
    CASE WHEN trouble IS NOT NULL OR kind IN ('error', 'snap') THEN moment ELSE cycle END,
    CASE WHEN kind IN ('snap', 'apply') THEN update_id ELSE last_id END, applied + (kind IN ('snap', 'apply'))::INT, gaps + coalesce((trouble = 'gap')::INT, 0),
    resyncs + (trouble IS NOT NULL)::INT, ok + (kind = 'snap' AND attempt > 0)::INT, failed + (trouble IS NOT NULL AND used >= {attempts})::INT,
    CASE WHEN kind = 'hold' THEN n + 1 WHEN trouble IS NOT NULL OR kind IN ('error', 'snap') THEN 0 ELSE n END
  FROM (SELECT *, CASE WHEN kind IN ('buffering', 'resync', 'error') THEN due ELSE ts_us END AS moment, CASE WHEN kind IN ('snap', 'error') THEN 0 ELSE attempt END AS used,
          CASE WHEN kind IN ('snap', 'apply') THEN wrong WHEN kind = 'gap' THEN 'gap' WHEN kind = 'buffering' THEN 'timeout' END AS trouble
    FROM (SELECT *, CASE WHEN due <= ts_us THEN mode WHEN is_snapshot THEN 'snap' WHEN mode <> 'live' THEN 'hold' WHEN update_id <> last_id + 1 THEN 'gap' ELSE 'apply' END AS kind
      FROM (SELECT s.* EXCLUDE (kind, met), m.ts_us, m.update_id, m.is_snapshot, m.wrong, since + CASE mode WHEN 'buffering' THEN {timeout} WHEN 'resync' THEN {backoff} * attempt
              WHEN 'error' THEN {rest} END AS due
            FROM st s JOIN ms m ON m.exchange = s.exchange AND m.symbol = s.symbol AND m.nth = s.nth + 1))))
"""


BUILDER = builder_sql("CASE WHEN seq % 97 = 0 THEN 'checksum' WHEN seq % 113 = 0 THEN 'crossed' WHEN seq % 131 = 0 THEN 'manual' END")


@query("builder_states", L2.replace("WITH", "WITH RECURSIVE", 1) + BUILDER + f"""
SELECT exchange, symbol, seq, mode AS state, reason, attempt, since AS since_us, kind = 'snap' AND met <> 'live' AS initialised, applied, gaps, resyncs,
       ok AS resyncs_ok, failed AS resyncs_failed, CAST(n - dropped AS BIGINT) AS buffered, CAST(dropped AS BIGINT) AS dropped
FROM (SELECT *, CASE WHEN n > {BUFFER} THEN ceil((n - {BUFFER}) / {BUFFER}) * {BUFFER} ELSE 0 END AS dropped FROM (
        SELECT st.*, seq FROM st JOIN ms ON ms.exchange = st.exchange AND ms.symbol = st.symbol AND ms.nth = st.nth) WHERE kind IN ('snap', 'hold', 'gap', 'apply'))""")
def _(spark, d):
    out = builder_states(flagged_messages(spark, d), CHUNK, BUFFER, TIMEOUT / 1e6, ATTEMPTS, BACKOFF // 1000, REST / 1e6)
    return out.select(
        *KEY, "seq", "state", "reason", "attempt", "since_us", "initialised", "applied", "gaps", "resyncs", "resyncs_ok", "resyncs_failed", "buffered", "dropped")


def flagged_messages(spark, d):
    """Messages with the findings that can put a builder out of step."""
    return b.messages(levels(spark, d)).withColumns({
        "checksum_ok": F.col("seq") % 97 != 0, "crossed": F.col("seq") % 113 == 0, "manual": F.col("seq") % 131 == 0})


@query("snapshot_delta_sync", L2 + CHAIN + """, s AS (
  SELECT exchange, symbol, seq, seq + 2 AS L FROM msg WHERE is_snapshot),
dl AS (SELECT exchange, symbol, seq, CASE WHEN update_id % 5 = 0 THEN update_id - 3 ELSE update_id END AS U,
       update_id AS u2, pu FROM c WHERE NOT is_snapshot),
j AS (SELECT d.*, s.seq AS snapshot_seq, s.L, u2 <= s.L AS stale FROM dl d ASOF JOIN s
      ON d.exchange = s.exchange AND d.symbol = s.symbol AND d.seq >= s.seq),
o AS (SELECT *, CASE WHEN stale THEN true WHEN coalesce(lag(stale) OVER w, true) THEN U <= L AND L <= u2
             ELSE coalesce(pu = lag(u2) OVER w, false) END AS ok FROM j
      WINDOW w AS (PARTITION BY exchange, symbol, snapshot_seq ORDER BY seq))
SELECT exchange, symbol, seq, snapshot_seq, U AS first_update_id, u2 AS update_id, pu AS prev_update_id,
       CASE WHEN stale THEN 'stale' WHEN coalesce(bool_or(NOT ok) OVER (PARTITION BY exchange, symbol, snapshot_seq
              ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'rejected'
            WHEN NOT ok THEN 'resync' ELSE 'accepted' END AS verdict
FROM o""")
def _(spark, d):
    rows = _chained(spark, d)
    snaps = rows.filter("is_snapshot").withColumn("last_update_id", F.col("seq") + 2)
    first = F.when(F.col("update_id") % 5 == 0, F.col("update_id") - 3).otherwise(F.col("update_id"))
    deltas = rows.filter("NOT is_snapshot").select(
        *KEY, "seq", first.alias("first_update_id"), "update_id", "prev_update_id"
    )
    out = b.snapshot_delta_sync(snaps, deltas, CHUNK)
    return out


L3 = """, st AS (
  SELECT *, CASE WHEN lag(epoch) OVER w = epoch THEN lag(quantity) OVER w ELSE 0 END AS held, lead(seq) OVER w AS nseq
  FROM ep WHERE epoch IS NOT NULL WINDOW w AS (PARTITION BY exchange, symbol, side, price_ticks ORDER BY seq)),
xe AS (
  SELECT exchange, symbol, side, price_ticks, price, seq, ts_us, CASE side WHEN 'bid' THEN 1 ELSE 2 END AS kind,
         CASE WHEN quantity = 0 THEN 'cancel' WHEN quantity > held THEN 'add' ELSE 'execute' END AS event_type,
         CASE WHEN quantity = 0 THEN held ELSE abs(quantity - held) END AS quantity
  FROM st WHERE (quantity = 0 AND held > 0) OR (quantity > 0 AND quantity <> held)
  UNION ALL
  SELECT s.exchange, s.symbol, s.side, s.price_ticks, s.price, m.seq, m.ts_us, 0, 'cancel', s.quantity
  FROM st s JOIN msg m ON s.exchange = m.exchange AND s.symbol = m.symbol AND s.next_epoch = m.seq
  WHERE s.quantity > 0 AND (s.nseq IS NULL OR s.nseq >= s.next_epoch))"""


@query("l3_events", L2 + L3 + """
SELECT exchange, symbol, side, price_ticks, price, seq, ts_us, event_type, quantity,
       row_number() OVER (PARTITION BY exchange, symbol ORDER BY seq, kind, side, price_ticks) AS order_id FROM xe""")
def _(spark, d):
    return b.l3_events(levels(spark, d), CHUNK)


DAY_MS = 86_400_000


@query("order_flow_imbalance_l3", L2 + L3 + f""", pe AS (
  SELECT exchange, symbol, seq, ts_us, coalesce(sum(quantity) FILTER (event_type = 'add' AND side = 'bid'), 0) AS buy,
         coalesce(sum(quantity) FILTER (event_type = 'add' AND side = 'ask'), 0) AS sell FROM xe GROUP BY ALL)
SELECT exchange, symbol, seq, buy, sell,
       round((sum(buy) OVER w - sum(sell) OVER w) / nullif(sum(buy) OVER w + sum(sell) OVER w, 0), 8) AS order_flow_imbalance
FROM pe WINDOW w AS (PARTITION BY exchange, symbol ORDER BY ts_us RANGE BETWEEN {20 * DAY_MS * 1000} PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    out = b.order_flow_imbalance_l3(b.l3_events(levels(spark, d), CHUNK), 20 * DAY_MS)
    return out.select("exchange", "symbol", "seq", "buy", "sell", F.round("order_flow_imbalance", 8).alias("order_flow_imbalance"))


# Row by row, every span at once: the held levels are a list, best first; every 17th message repeats an older id.
FIXED = """
, fd AS (SELECT *, CASE WHEN seq % 17 = 0 THEN update_id - 5 ELSE update_id END AS uid FROM ep WHERE epoch IS NOT NULL),
fm AS (SELECT exchange, symbol, epoch, seq, max(uid) AS uid FROM fd GROUP BY ALL),
fk AS (SELECT exchange, symbol, seq FROM (SELECT *, max(uid) OVER (PARTITION BY exchange, symbol, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM fm)
  WHERE newest IS NULL OR uid > newest),
fr AS MATERIALIZED (SELECT exchange, symbol, side, epoch, seq, quantity, CASE side WHEN 'bid' THEN -price_ticks ELSE price_ticks END AS k,
  row_number() OVER (PARTITION BY exchange, symbol, side, epoch ORDER BY seq, price_ticks) AS nth,
  row_number() OVER (PARTITION BY exchange, symbol, side, seq ORDER BY price_ticks DESC) = 1 AS emits FROM fd SEMI JOIN fk USING (exchange, symbol, seq)),
ff AS (
  SELECT exchange, symbol, side, epoch, 0::BIGINT AS nth, 0::BIGINT AS seq, false AS emits, []::STRUCT(k BIGINT, q DOUBLE)[] AS held FROM fr WHERE nth = 1
  UNION ALL
  SELECT r.exchange, r.symbol, r.side, r.epoch, r.nth, r.seq, r.emits,
    list_sort(list_filter(f.held, lambda x: x.k <> r.k) || CASE WHEN r.quantity > 0 THEN [{'k': r.k, 'q': r.quantity}] ELSE [] END)[1:20]
  FROM ff f JOIN fr r ON r.exchange = f.exchange AND r.symbol = f.symbol AND r.side = f.side AND r.epoch = f.epoch AND r.nth = f.nth + 1)
SELECT exchange, symbol, side, epoch, seq, len(held) AS levels, abs(held[1].k) AS best_ticks, coalesce(list_sum(list_transform(held, lambda x: x.q)), 0.0) AS quantity
FROM ff WHERE emits"""


@query("fixed_depth_book", L2.replace("WITH", "WITH RECURSIVE", 1) + FIXED)
def _(spark, d):
    old = F.when(F.col("seq") % 17 == 0, F.col("update_id") - 5).otherwise(F.col("update_id"))
    return b.fixed_depth_book(levels(spark, d).withColumn("update_id", old), CHUNK, 20)


NUM = "rtrim(rtrim(CAST(CAST({} AS DECIMAL(28,8)) AS VARCHAR), '0'), '.')"
SPELL = NUM.format("price") + " || ':' || " + NUM.format("quantity")


@query("book_checksum", BOOK + f"""
SELECT exchange, symbol, seq, md5(coalesce(string_agg({SPELL} || '|', '' ORDER BY rk) FILTER (side = 'bid'), '') || '||'
       || coalesce(string_agg({SPELL} || '|', '' ORDER BY rk) FILTER (side = 'ask'), '')) AS checksum
FROM lv GROUP BY ALL""")
def _(spark, d):
    out = b.book_checksum(replayed(levels(spark, d), CHUNK, checksums=("md5",)), "md5")
    return out.select("exchange", "symbol", "seq", "checksum")


# CRC-32 in SQL: the table of its 256 steps, then a fold over the bytes of the text.
CRC = """, tb AS (SELECT list(list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), n) ORDER BY n) AS steps FROM range(256) r(n)),
tx AS (SELECT exchange, symbol, seq, coalesce(string_agg(spell, ':' ORDER BY rk, side DESC) FILTER (rk <= 25 AND side IS NOT NULL), '') AS text
  FROM (SELECT *, """ + SPELL + """ AS spell FROM lv) GROUP BY ALL)
SELECT exchange, symbol, seq, lpad(lower(to_hex(xor(list_reduce([4294967295] || list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT),
  lambda c, x: xor(c >> 8, steps[xor(c, x) % 256 + 1])), 4294967295))), 8, '0') AS checksum FROM tx, tb"""


@query("book_checksum_crc32", BOOK + CRC)
def _(spark, d):
    out = b.book_checksum(replayed(levels(spark, d), CHUNK, checksums=("crc32",)), "crc32")
    return out.select("exchange", "symbol", "seq", "checksum")


@query("checksum_audit", L2 + """, ck AS (
  SELECT exchange, symbol, seq, NOT (seq % 11 <> 0 AND seq % 40 < 9) AS valid FROM msg),
r AS (SELECT *, count(*) OVER w AS checks, CAST(sum((NOT valid)::INT) OVER w AS BIGINT) AS failures FROM ck
      WINDOW w AS (PARTITION BY exchange, symbol ORDER BY seq)),
z AS (SELECT *, failures - coalesce(max(CASE WHEN valid THEN failures END) OVER (
        PARTITION BY exchange, symbol ORDER BY seq), 0) AS consecutive_failures FROM r)
SELECT exchange, symbol, seq, valid, checks, failures, consecutive_failures, consecutive_failures >= 5 AS needs_resync,
       round((checks - failures) / checks, 8) AS success_rate FROM z""")
def _(spark, d):
    computed = F.md5(F.concat_ws("|", "exchange", "symbol", F.col("seq").cast("string")))
    received = F.when(F.col("seq") % 11 == 0, F.lit(None)).when(F.col("seq") % 40 < 9, "corrupt").otherwise(computed)
    rows = b.messages(levels(spark, d)).withColumns({"computed": computed, "received": received})
    out = b.checksum_audit(rows, CHUNK)
    return out.select(
        "exchange", "symbol", "seq", "valid", "checks", "failures", "consecutive_failures", "needs_resync",
        F.round("success_rate", 8).alias("success_rate"),
    )


def update_arrays(spark, d):
    """Update messages with level lists; some timestamps step back and some bid lists are reversed."""
    level = F.struct("price", "quantity")
    grouped = levels(spark, d).groupBy(*KEY, "seq").agg(
        F.max("ts_us").alias("ts_us"), F.max("is_snapshot").alias("is_snapshot"), F.max("update_id").alias("update_id"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "bid", level)), asc=False).alias("bids"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "ask", level))).alias("asks"),
    )
    return grouped.withColumns({
        "bids": F.when(F.col("seq") % 37 == 0, F.reverse("bids")).otherwise(F.col("bids")),
        "ts_us": F.when(F.col("seq") % 29 == 0, F.col("ts_us") - 20 * 86_400_000_000).otherwise(F.col("ts_us")),
    })


UPD = """, up AS (
  SELECT exchange, symbol, seq, max(ts_us) - CASE WHEN seq % 29 = 0 THEN 1728000000000 ELSE 0 END AS ts_us,
         CASE WHEN seq % 37 = 0 THEN min(price) FILTER (side = 'bid') ELSE max(price) FILTER (side = 'bid') END AS bb,
         min(price) FILTER (side = 'ask') AS ba, count(*) FILTER (side = 'bid') AS nb FROM fx_l2 GROUP BY exchange, symbol, seq),
um AS (SELECT *, (bb + ba) / 2 AS mid FROM up),
ul AS (SELECT *, max(ts_us) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lts FROM um
       WINDOW w AS (PARTITION BY exchange, symbol ORDER BY seq)),
ue AS (SELECT *, CASE WHEN ts_us < lts THEN 'non_monotonic' WHEN (1004832000000000 - ts_us) / 1000 > 180000000000 THEN 'stale'
            WHEN seq % 37 = 0 AND nb > 1 THEN 'bids_unsorted' WHEN bb >= ba THEN 'crossed' END AS early FROM ul)"""


@query("book_validation", L2.replace("WITH", "WITH RECURSIVE", 1) + UPD + last_accepted("ue", "mid", "seq", 0.3) + """
SELECT exchange, symbol, seq, round(mid, 6) AS mid, coalesce(early, CASE WHEN outlier THEN 'outlier' END) AS violation
FROM numbered JOIN judged USING (exchange, symbol, nth)""")
def _(spark, d):
    out = b.book_validation(update_arrays(spark, d), CHUNK, 0.3, 180_000_000_000, F.lit(1_004_832_000_000_000))
    return out.select("exchange", "symbol", "seq", F.round("mid", 6).alias("mid"), "violation")
