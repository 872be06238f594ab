"""File sources and sinks: gzipped CSV history, subscription configs, partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import scalars as s
from tickloom.plans.ordered import CHUNK, cumsum, prev, scan

L2_SCHEMA = "timestamp long, side string, price double, amount double, is_snapshot boolean"
TRADE_SCHEMA = "timestamp long, price double, amount double, side string, id string"
CONFIG_SCHEMA = (
    "subscribe_data struct<spot_symbols:array<string>,futures_symbols:array<string>,krw_symbols:array<string>,"
    "codes:array<string>>"
)


def _dated(df: DataFrame, dates: list[str] | None) -> DataFrame:
    """Symbol and date from `<symbol>/<date>_<symbol>.csv.gz` or `symbol=<symbol>/date=<date>/`."""
    path = F.col("_metadata.file_path")
    out = df.withColumns({
        "symbol": F.regexp_extract(path, r"/(?:symbol=)?([^/=]+)/(?:date=[^/]+/)?[^/]+$", 1),
        "date": F.coalesce(F.nullif(F.regexp_extract(path, r"/date=([^/]+)/", 1), F.lit("")),
                           F.nullif(F.regexp_extract(path, r"/(\d{4}-\d{2}-\d{2})_[^/]+$", 1), F.lit(""))),
    })
    return out.filter(F.col("date").isin(*dates)) if dates else out


def _globs(spark: SparkSession, base: str, folder: str, symbols: list[str] | None, dates: list[str] | None, hive: bool):
    """Path patterns that already name the wanted symbols and dates, so other files are not opened."""
    if hive:
        return [
            f"{base}/{folder}/symbol={sym}/date={day}/*" for sym in (symbols or ["*"]) for day in (dates or ["*"])
        ]
    return [f"{base}/{folder}/{sym}/{day}_*.csv.gz" for sym in (symbols or ["*"]) for day in (dates or ["*"])]


def scan_l2_csv(spark, base: str, symbols: list[str] | None = None, dates: list[str] | None = None, hive: bool = False):
    """Incremental L2 rows. A gz file is one task, so convert history once with `to_columnar`."""
    paths = _globs(spark, base, "incremental_book_L2", symbols, dates, hive)
    return _dated(spark.read.schema(L2_SCHEMA).option("header", True).csv(paths), dates)


def scan_trades_csv(spark, base: str, symbols: list[str] | None = None, dates: list[str] | None = None, hive: bool = False):
    """Trades; a missing side counts as sell, a missing id as 'unknown'."""
    paths = _globs(spark, base, "trades", symbols, dates, hive)
    rows = _dated(spark.read.schema(TRADE_SCHEMA).option("header", True).csv(paths), dates)
    side = F.when(F.lower("side") == "buy", "buy").otherwise("sell")
    return rows.withColumns({"side": side, "id": F.coalesce("id", F.lit("unknown"))})


def to_columnar(df: DataFrame, path: str) -> None:
    """One-off conversion of unsplittable history to Parquet by symbol and date."""
    df.repartition("symbol", "date").sortWithinPartitions("symbol", "date", "timestamp").write.mode("append").partitionBy(
        "symbol", "date"
    ).parquet(path)


def group_l2_rows(df: DataFrame, chunk, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Consecutive rows of one timestamp and one snapshot flag become one update with level lists."""
    keys, order = keys or ["symbol"], order or ["timestamp", "row"]
    known = df.filter(F.col("side").isin("bid", "ask"))
    linked = scan(known, keys, order, chunk, keep_chunk=True, _p=prev(F.struct("timestamp", "is_snapshot")))
    starts = F.col("_p").isNull() | (F.col("_p.timestamp") != F.col("timestamp")) | (
        F.col("_p.is_snapshot") != F.col("is_snapshot"))
    marked = scan(linked.withColumn("_s", starts.cast("long")), keys, order, F.col(CHUNK), update=cumsum(F.col("_s")))
    item = F.struct(*[F.col(c) for c in order], "price", F.col("amount").alias("quantity"))

    def side(name: str):
        got = F.sort_array(F.collect_list(F.when(F.col("side") == name, item)))
        return F.transform(got, lambda x: F.struct(x["price"].alias("price"), x["quantity"].alias("quantity"))).alias(f"{name}s")

    return marked.groupBy(*keys, "update", "timestamp", "is_snapshot").agg(side("bid"), side("ask"))


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Subscription configs, one row per file; the exchange is the start of the file name."""
    raw = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/_]+)[^/]*\.json$", 1)
    return raw.withColumn("exchange", name)


def sink_spreads(df: DataFrame, path: str) -> None:
    """Spread rows appended to one CSV folder per symbol, percent at two decimals."""
    df.withColumn("spread_percent", F.round("spread_percent", 2)).write.mode("append").partitionBy("symbol").option(
        "header", True
    ).csv(path)


def sink_ops_tables(df: DataFrame, path: str, max_len: int = 800) -> None:
    """Log rows (`table`, ts, message, ...) appended by table and date, messages made safe."""
    message = s.escape_log(s.truncate_log(F.col("message"), max_len))
    rows = df.withColumns({"message": message, "date": F.to_date("ts")})
    rows.write.mode("append").partitionBy("table", "date").parquet(path)


def sink_market_tables(df: DataFrame, path: str) -> None:
    """Trades or books by date and exchange, sorted by symbol and time for range reads.

    Rows are dealt in ranges of about equal size, so a busy venue-day is written by as many tasks as it has of the rows.
    """
    order = ["date", "exchange", "symbol", "ts"]
    rows = df.withColumn("date", F.to_date("ts")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("append").partitionBy("date", "exchange").parquet(path)


def export_report(tables: dict[str, DataFrame], path: str | None, as_of_us: int) -> DataFrame:
    """Write every table as CSV (if a path is given) and return its summary: rows per table and
    whether the market is open at the time (weekdays 09:00-15:30)."""
    if path:
        for name, df in tables.items():
            df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = row if out is None else out.unionByName(row)
    at = F.timestamp_micros(F.lit(as_of_us))
    minutes = F.hour(at) * 60 + F.minute(at)
    is_open = F.dayofweek(at).between(2, 6) & minutes.between(9 * 60, 15 * 60 + 30)
    return out.withColumn("market_open", is_open)
