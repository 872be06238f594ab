"""Instrument masters, option chains, screens, portfolio risk and daily signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.ratios import ratio
from tickloom.plans.ordered import chunk_of, cumsum, order_statistics, prev, scan
from tickloom.plans.sliding import rows as rows_in
from tickloom.plans.sliding import sliding, total
from tickloom.session import ship_by_value

ship_by_value(__name__)

# Underlying codes of Korean futures and options.
FUTURES_UNDERLYING = {
    "101": "KOSPI200", "105": "KQ150", "106": "KOSPI200Mini", "167": "USD", "175": "KTB3Y", "276": "KTB10Y",
}
OPTIONS_UNDERLYING = {"01": "KOSPI200", "05": "KQ150", "06": "KOSPI200Mini"}

# Month letters; A to L and again M to X stand for January to December.
MONTH_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWX"

# Contract month letters of quarterly futures.
QUARTER_LETTERS = {3: "H", 6: "M", 9: "U", 12: "Z"}

DAY_US = 86_400_000_000


def _lookup(code: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, code), F.lit("Unknown"))


def parse_instrument_code(df: DataFrame, code: str = "code") -> DataFrame:
    """Fields of futures codes (`101RC000`) and option codes (`201RC240`, first digit 2 call, 3 put).

    `asset` says which kind a row is. Strikes of the main index count in steps of 2.5; codes
    that are too short have NULL fields.
    """
    c = F.col(code)
    future, option = F.col("asset") == "futures", F.col("asset") == "options"
    long_enough = F.length(c) >= F.when(future, 6).otherwise(7)
    under = F.when(future, F.substring(c, 1, 3)).when(option, F.substring(c, 2, 2))
    letter = F.substring(c, 4, 1)
    at = F.instr(F.lit(MONTH_LETTERS), letter)
    month = F.when(at > 0, F.lpad(((at - 1) % 12 + 1).cast("string"), 2, "0")).otherwise("Unknown")
    strike_code = F.substring(c, 6, 100)
    digits = F.coalesce(strike_code.try_cast("int"), F.lit(0))
    name = F.when(future, _lookup(under, FUTURES_UNDERLYING)).when(option, _lookup(under, OPTIONS_UNDERLYING))
    fields = {
        "underlying": name, "underlying_code": under, "month": month, "month_code": letter,
        "year_code": F.substring(c, 5, 1),
        "option_type": F.when(option, F.when(F.substring(c, 1, 1) == "2", "Call").otherwise("Put")),
        "strike_price": F.when(option, F.when(under == "01", digits * 2.5).otherwise(digits.cast("double"))),
    }
    return df.withColumns({k: F.when(long_enough, v) for k, v in fields.items()})


def moneyness(df: DataFrame) -> DataFrame:
    """spot / strike, its distance from 1 and class; ITM is tested before ATM, as published."""
    m = F.when(F.col("strike_price") > 0, F.col("spot_price") / F.col("strike_price"))
    away = F.abs(F.col("moneyness") - 1)
    label = F.when(F.col("moneyness") > 1, "ITM").when(F.col("atm_distance") < 0.02, "ATM").when(
        F.col("moneyness").isNotNull(), "OTM")
    return df.withColumn("moneyness", m).withColumn("atm_distance", away).withColumn("classification", label)


def futures_basis(df: DataFrame, rate: float = 0.03) -> DataFrame:
    """Basis, cost-of-carry price, premium and annualised basis; NULL without spot or time left."""
    spot, price, days = F.col("spot_price"), F.col("futures_price"), F.col("days_to_expiry")
    ok = (spot > 0) & (days > 0)
    years = days / 365.0
    fair = spot * (1 + rate * years)
    return df.withColumns({
        name: F.when(ok, value) for name, value in {
            "basis": price - spot, "basis_percentage": (price - spot) / spot * 100, "theoretical_price": fair,
            "premium_discount": price - fair, "annualized_basis": (price - spot) / years,
        }.items()
    })


def second_thursday(first_day: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(first_day, 1), "Thu"), 7)


def expiry_calendar(starts: DataFrame, months: int = 12) -> DataFrame:
    """Next contract expiries after each `start` date: quarterly futures and monthly options,
    both on the second Thursday."""
    steps = starts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(months - 1))))
    quarter = F.element_at(F.array(*[F.lit(m) for m in QUARTER_LETTERS]), F.col("i") % 4 + 1)
    letters = F.create_map(*[F.lit(x) for kv in QUARTER_LETTERS.items() for x in kv])
    futures = steps.select(
        "start", F.lit("futures").alias("contract"), "i",
        F.make_date(F.year("start") + F.floor(F.col("i") / 4).cast("int"), quarter, F.lit(1)).alias("first_day"),
    ).withColumn("month_code", F.try_element_at(letters, F.month("first_day")))
    options = steps.select(
        "start", F.lit("options").alias("contract"), "i", F.trunc(F.date_add("start", F.col("i") * 30), "month").alias("first_day")
    ).withColumn("month_code", F.substring(F.lit(MONTH_LETTERS), 1, 12))
    options = options.withColumn("month_code", F.substring("month_code", F.month("first_day"), F.lit(1)))
    both = futures.unionByName(options)
    year_code = F.substring(F.year("first_day").cast("string"), 4, 1)
    return both.select(
        "start", "contract", "i", second_thursday(F.col("first_day")).alias("expiry_date"), F.month("first_day").alias("month"),
        F.year("first_day").alias("year"), "month_code", year_code.alias("year_code"),
        F.concat("month_code", year_code).alias("contract_code"),
    )


# --- chains and screens ----------------------------------------------------------------------


def options_with_quotes(options: DataFrame, quotes: DataFrame, since_us: Column | int) -> DataFrame:
    """Master rows with the quotes since a time, by strike; as the time filter is on the quote
    side, options without a recent quote drop out."""
    recent = quotes.filter(F.col("ts_us") > (since_us if isinstance(since_us, Column) else F.lit(since_us)))
    return options.join(recent, "option_code").orderBy("strike_price", "option_code")


def straddles(options: DataFrame, min_iv: float = 20, k: int = 3, by: tuple[str, ...] = ("strike_price",)) -> DataFrame:
    """First call and first put of each strike: cost and mean IV, the k lowest strikes above min_iv."""
    first = F.struct("option_code", "current_price", "implied_volatility")
    call, put = F.col("option_type") == "C", F.col("option_type") == "P"
    pairs = options.groupBy(*by).agg(F.min(F.when(call, first)).alias("c"), F.min(F.when(put, first)).alias("p"))
    pairs = pairs.filter("c IS NOT NULL AND p IS NOT NULL").select(
        *by, F.col("c.option_code").alias("call_code"), F.col("p.option_code").alias("put_code"),
        (F.col("c.current_price") + F.col("p.current_price")).alias("total_cost"),
        ((F.col("c.implied_volatility") + F.col("p.implied_volatility")) / 2).alias("mean_iv"),
    )
    return pairs.filter(F.col("mean_iv") > min_iv).orderBy(*by).limit(k)


def derivatives_by_underlying(futures: DataFrame, options: DataFrame, text: str) -> DataFrame:
    """Futures and options whose underlying contains the text."""
    def part(df: DataFrame, kind: str, code: str, strike: Column) -> DataFrame:
        return df.filter(F.col("underlying").contains(text)).select(
            F.lit(kind).alias("kind"), F.col(code).alias("code"), "underlying", F.col("expiry_idx").alias("expiry"),
            strike.alias("strike_price"),
        )

    both = part(futures, "futures", "futures_code", F.lit(None).cast("double")).unionByName(
        part(options, "options", "option_code", F.col("strike_price")))
    return both.orderBy("kind", "expiry", "strike_price", "code")


def options_chain(options: DataFrame, underlying: str, expiry: int | str) -> DataFrame:
    chain = options.filter(F.col("underlying").contains(underlying) & (F.col("expiry_idx") == expiry))
    return chain.orderBy("strike_price", "option_type", "option_code")


def screen_liquid_options(options: DataFrame, min_volume: int = 100, min_oi: int = 1000) -> DataFrame:
    liquid = (F.col("volume") >= min_volume) | (F.col("open_interest") >= min_oi)
    return options.filter(liquid).orderBy(F.col("volume").desc(), F.col("open_interest").desc())


def screen_near_expiry(futures: DataFrame, days: int = 30, as_of: Column | None = None) -> DataFrame:
    left = F.datediff(F.col("expiry_date"), as_of if as_of is not None else F.current_date())
    out = futures.withColumn("days_to_expiry", left.cast("long"))
    return out.filter((F.col("days_to_expiry") > 0) & (F.col("days_to_expiry") <= days)).orderBy("days_to_expiry")


def quantile_of(df: DataFrame, value: str, q: float, chunk_width: float) -> Column:
    """The q-quantile with linear interpolation as a scalar subquery, exact at any size."""
    at = (F.col("n") - 1) * F.lit(q)
    stats = order_statistics(df, [], value, {"lo": F.floor(at), "hi": F.ceil(at)}, F.floor(F.col(value) / chunk_width))
    part = at - F.floor(at)
    return stats.select(F.col("lo") + (F.col("hi") - F.col("lo")) * part).scalar()


def screen_high_iv(options: DataFrame, q: float = 0.8) -> DataFrame:
    limit = quantile_of(options, "implied_volatility", q, 10)
    return options.withColumn("threshold", limit).filter(F.col("implied_volatility") >= F.col("threshold")).orderBy(
        F.col("implied_volatility").desc())


def volatility_signal(options: DataFrame, q: float = 0.8, k: int = 3) -> DataFrame:
    limit = quantile_of(options, "implied_volatility", q, 10)
    high = options.filter(F.col("implied_volatility") > limit)
    return high.orderBy(F.col("implied_volatility").desc(), "option_code").limit(k).withColumn("signal", F.lit("SELL VOL"))


def screen_covered_calls(options: DataFrame, k: int = 5) -> DataFrame:
    rate = F.col("current_price") / F.col("strike_price") * 100
    hits = options.filter("option_type = 'C'").withColumn("premium_yield", rate)
    return hits.filter("premium_yield > 1 AND delta < 0.3").orderBy("strike_price", "option_code").limit(k)


def screen_protective_puts(options: DataFrame, k: int = 5) -> DataFrame:
    hits = options.filter("option_type = 'P' AND delta > -0.3 AND delta < -0.1")
    return hits.orderBy("strike_price", "option_code").limit(k)


def put_call_ratio(options: DataFrame) -> DataFrame:
    def part(kind: str, value: str) -> Column:
        return F.sum(F.when(F.col("option_type") == kind, F.col(value)).otherwise(0))

    sums = options.groupBy("underlying").agg(
        part("C", "volume").alias("cv"), part("P", "volume").alias("pv"), part("C", "open_interest").alias("co"),
        part("P", "open_interest").alias("po"),
    )
    zero = F.lit(0.0)
    out = sums.withColumns({
        "pcr_volume": F.when(F.col("cv") > 0, F.col("pv") / F.col("cv")).otherwise(zero),
        "pcr_open_interest": F.when(F.col("co") > 0, F.col("po") / F.col("co")).otherwise(zero),
        "total_volume": F.col("cv") + F.col("pv"), "total_open_interest": F.col("co") + F.col("po"),
    })
    mood = F.when(F.col("pcr_volume") > 1, "Bearish").when(F.col("pcr_volume").between(0.8, 1.2), "Neutral").otherwise("Bullish")
    return out.withColumn("market_sentiment", mood).drop("cv", "pv", "co", "po")


def options_chain_summary(options: DataFrame) -> DataFrame:
    """Counts, open interest, summed Greeks, strikes and the strike with the largest open interest."""
    call, put = F.col("option_type") == "C", F.col("option_type") == "P"
    oi = F.col("open_interest")
    greeks = [g for g in ("delta", "gamma", "theta", "vega") if g in options.columns]
    per = options.groupBy("underlying", "strike_price").agg(
        F.count(F.when(call, 1)).alias("c"), F.count(F.when(put, 1)).alias("p"), F.sum(F.when(call, oi).otherwise(0)).alias("co"),
        F.sum(F.when(put, oi).otherwise(0)).alias("po"), F.sum(oi).alias("oi"), *[F.sum(g).alias(g) for g in greeks],
    )
    base = per.groupBy("underlying").agg(
        F.sum("c").alias("total_calls"), F.sum("p").alias("total_puts"), F.sum("co").alias("total_call_oi"),
        F.sum("po").alias("total_put_oi"), F.max_by("strike_price", F.struct("oi", -F.col("strike_price"))).alias("max_oi_strike"),
        F.min(F.when(F.col("strike_price") > 0, F.col("strike_price"))).alias("min_strike"), F.max("strike_price").alias("max_strike"),
        *[F.sum(g).alias(f"total_{g}") for g in greeks],
    )
    expiries = options.groupBy("underlying").agg(F.countDistinct("expiry_idx").alias("expiries"))
    return base.join(expiries, "underlying")


# --- portfolio and signals -------------------------------------------------------------------


def portfolio_exposure(realtime: DataFrame, since_us: int) -> DataFrame:
    per = realtime.filter(F.col("ts_us") > since_us).groupBy("asset_type").agg(
        F.count(F.lit(1)).alias("positions"), F.sum(F.col("current_price") * F.col("volume")).alias("market_value")
    )
    total = F.sum("market_value").over(Window.partitionBy())  # one row per asset type
    return per.withColumn("share_pct", F.coalesce(ratio(F.col("market_value"), total) * 100, F.lit(0.0)))


def var_95(realtime: DataFrame, since_us: int, z: float = 1.645) -> DataFrame:
    last = realtime.filter(F.col("ts_us") > since_us).groupBy("symbol").agg(
        F.max_by("change_rate", F.struct("ts_us", "id")).alias("last_return"))
    out = last.agg(F.count(F.lit(1)).alias("symbols"), F.avg("last_return").alias("portfolio_return"),
                   F.stddev_samp("last_return").alias("portfolio_vol"))
    return out.withColumn("var_95", F.col("portfolio_return") - z * F.col("portfolio_vol"))


TILE, BLOCK_CELLS = 64, 1_024
_PAIR = "a int, b int, n long, sx double, sy double, sxx double, syy double, sxy double"


def _gram(tile: int):
    """Moments of the pairs of two tiles of symbols from rows (i, j, slab, cell, idx, v) sorted by these, a block of cells at a time."""
    import numpy as np
    import pyarrow as pa

    names = [f.split()[0] for f in _PAIR.split(", ")]

    def moments(cells, columns, values):
        found, row = np.unique(cells, return_inverse=True)
        x, seen = np.zeros((len(found), 2 * tile)), np.zeros((len(found), 2 * tile))
        x[row, columns], seen[row, columns] = values, 1.0
        left, right = slice(0, tile), slice(tile, 2 * tile)
        return np.stack([
            seen[:, left].T @ seen[:, right], x[:, left].T @ seen[:, right], seen[:, left].T @ x[:, right], (x[:, left] ** 2).T @ seen[:, right],
            seen[:, left].T @ x[:, right] ** 2, x[:, left].T @ x[:, right]])

    def finished(i: int, j: int, sums) -> pa.RecordBatch:
        a, b = np.nonzero(sums[0])
        keep = a + i * tile < b + j * tile
        a, b = a[keep], b[keep]
        values = [pa.array((a + i * tile).astype(np.int32)), pa.array((b + j * tile).astype(np.int32)), pa.array(sums[0, a, b].astype(np.int64))]
        return pa.record_batch([*values, *[pa.array(sums[k, a, b]) for k in range(1, 6)]], names=names)

    def run(batches):
        here, sums, held = None, None, []

        def flush():
            nonlocal sums, held
            if held:
                cells, columns, values = (np.concatenate(c) for c in zip(*held))
                sums, held = sums + moments(cells, columns, values), []

        for batch in batches:
            i, j, slab, cell, idx, v = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edges = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(slab) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(i)]):
                if hi == lo:
                    continue
                if here != (i[lo], j[lo], slab[lo]):
                    flush()
                    if here is not None:
                        yield finished(here[0], here[1], sums)
                    here, sums = (i[lo], j[lo], slab[lo]), np.zeros((6, tile, tile))
                at = idx[lo:hi]
                column = np.where(at // tile == here[0], at % tile, tile + at % tile)
                held.append((cell[lo:hi], column, v[lo:hi]))
                if here[0] == here[1]:  # a tile with itself stands on both sides
                    held.append((cell[lo:hi], tile + at % tile, v[lo:hi]))
                # cut only between cells
                if sum(len(h[0]) for h in held) > BLOCK_CELLS * tile:
                    cells, columns, values = (np.concatenate(c) for c in zip(*held))
                    done = cells < cells.max()
                    if done.any():
                        sums = sums + moments(cells[done], columns[done], values[done])
                    held = [(cells[~done], columns[~done], values[~done])]
        flush()
        if here is not None:
            yield finished(here[0], here[1], sums)

    return run


def return_correlation(realtime: DataFrame, symbols: list[str], since_us: int, bucket_us: int = 1_000_000, slab_cells: int = 1_000_000) -> DataFrame:
    """Pairwise correlation of change_rate (mean per symbol and time cell) over a list of symbols.

    A pair counts the cells in which both have a value; pairs without one are left out, and without spread the correlation is NULL.
    The plan does not grow with the list: symbols are numbered and cut into tiles, every two tiles and slab of cells meet once, and
    the moments of all their pairs come from matrix products over blocks of cells.
    """
    spark = realtime.sparkSession
    numbers = spark.createDataFrame([(s, n) for n, s in enumerate(symbols)], "symbol string, idx int")
    tiles = -(-max(len(symbols), 1) // TILE)
    cells = realtime.filter(F.col("ts_us") > since_us).join(numbers, "symbol").groupBy(
        "idx", F.floor(F.col("ts_us") / bucket_us).alias("cell")).agg(F.avg("change_rate").alias("v")).filter(F.col("v").isNotNull())
    # less its mean, so that the moments do not cancel
    centred = cells.join(cells.groupBy("idx").agg(F.avg("v").alias("m")), "idx").select("idx", "cell", (F.col("v") - F.col("m")).alias("v"))
    own = F.floor(F.col("idx") / TILE).cast("int")
    meets = centred.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select(
        F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), F.floor(F.col("cell") / slab_cells).alias("slab"), "cell", "idx", "v")
    sorted_ = meets.repartition("i", "j", "slab").sortWithinPartitions("i", "j", "slab", "cell")
    sums = sorted_.mapInArrow(_gram(TILE), _PAIR).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    across, along, down = (n * F.col(c) - F.col(p) * F.col(q) for c, p, q in (("sxy", "sx", "sy"), ("sxx", "sx", "sx"), ("syy", "sy", "sy")))
    spread = F.sqrt(along) * F.sqrt(down)
    value = F.when((n > 1) & (along > 0) & (down > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), across / spread)))
    first, second = (numbers.select(F.col("idx").alias(i), F.col("symbol").alias(s)) for i, s in (("a", "symbol1"), ("b", "symbol2")))
    return sums.join(first, "a").join(second, "b").select("symbol1", "symbol2", value.alias("correlation"), n.alias("cells"))


def momentum_signal(realtime: DataFrame, k: int = 5, chunk_us: int = DAY_US) -> DataFrame:
    """Rising faster than before on more than median volume: the newest k."""
    linked = scan(realtime, ["symbol"], ["ts_us", "id"], chunk_of("ts_us", chunk_us), prev_change=prev(F.col("change_rate")))
    middle = quantile_of(realtime, "volume", 0.5, 10)
    hit = (F.col("change_rate") > 0) & (F.col("change_rate") > F.col("prev_change")) & (F.col("volume") > middle)
    return linked.filter(hit).orderBy(F.col("ts_us").desc(), F.col("id").desc()).limit(k)


def mean_reversion_signal(realtime: DataFrame, n: int = 10, z: float = 2, chunk_us: int = DAY_US, rows_per_chunk: int = 100_000):
    """z of the change against the mean of the last n rows and the deviation of its symbol; |z| > limit."""
    rows = scan(realtime, ["symbol"], ["ts_us", "id"], chunk_of("ts_us", chunk_us), _rn=cumsum(F.lit(1)))
    seen = F.col("change_rate")
    out = sliding(rows, ["symbol"], "_rn", n - 1, rows_per_chunk, _t=total(seen), _n=rows_in(seen.isNotNull()))
    out = out.withColumn("recent_avg", F.col("_t") / F.col("_n")).drop("_t", "_n")
    std = realtime.groupBy("symbol").agg(F.stddev_samp("change_rate").alias("_sd"))
    score = ratio(F.col("change_rate") - F.col("recent_avg"), F.col("_sd"))
    out = out.join(std, "symbol").withColumn("z_score", score).filter(F.abs("z_score") > z)
    return out.withColumn("signal", F.when(F.col("z_score") > 0, "SELL").otherwise("BUY")).drop("_rn", "_sd")


def recent_by_asset(realtime: DataFrame, as_of_us: Column | int, k: int = 3, window_us: int = 60_000_000) -> DataFrame:
    """Newest k rows per asset type within the window before a time."""
    newest = Window.partitionBy("asset_type").orderBy(F.col("ts_us").desc(), F.col("id").desc())
    at = as_of_us if isinstance(as_of_us, Column) else F.lit(as_of_us)
    recent = realtime.filter((F.col("ts_us") > at - window_us) & (F.col("ts_us") <= at))
    return recent.withColumn("rank", F.row_number().over(newest).cast("long")).filter(F.col("rank") <= k)


# --- universes and counts --------------------------------------------------------------------


def common_pairs(symbols: DataFrame, min_venues: int = 2, k: int = 50, quotes: tuple[str, ...] = ("USDT", "USD")) -> DataFrame:
    """Spot pairs in the given quote assets listed on several venues, most venues first."""
    per = symbols.filter((F.col("market") == "spot") & F.col("quote").isin(*quotes)).groupBy("base", "quote").agg(
        F.collect_set("exchange").alias("x"))
    listed = per.withColumns({"venues": F.size("x").cast("long"), "exchanges": F.array_join(F.sort_array("x"), ", ")})
    return listed.filter(F.col("venues") >= min_venues).orderBy(F.col("venues").desc(), "base", "quote").limit(k).drop("x")


def popular_universe(master: DataFrame, codes: DataFrame, by: str = "market") -> DataFrame:
    """Rows per market of the master, and how many are on the code list."""
    marked = master.join(codes.select("code").distinct().withColumn("_hit", F.lit(1)), "code", "left")
    return marked.groupBy(by).agg(F.count(F.lit(1)).alias("listed"), F.count("_hit").alias("popular"))


def symbol_report(symbols: DataFrame) -> DataFrame:
    """Spot and futures symbols per exchange with a total row."""
    spot, fut = F.col("market") == "spot", F.col("market") == "futures"
    return symbols.rollup("exchange").agg(
        F.count(F.when(spot, 1)).alias("spot"), F.count(F.when(fut, 1)).alias("futures"), F.count(F.lit(1)).alias("total"))


def quote_asset_topk(symbols: DataFrame, k: int = 10) -> DataFrame:
    name = F.when(F.col("market") == "futures", F.concat("quote", F.lit("_futures"))).otherwise(F.col("quote"))
    per = symbols.groupBy("exchange", name.alias("quote_asset")).agg(F.count(F.lit(1)).alias("symbols"))
    order = Window.partitionBy("exchange").orderBy(F.col("symbols").desc(), "quote_asset")
    return per.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def asset_counts(masters: dict[str, DataFrame], realtime: DataFrame, k: int = 5) -> DataFrame:
    """Rows per master, realtime rows per asset type with their time range, and the k most active symbols."""
    out = None
    for name, df in masters.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("master").alias("section"), F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    span = [F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")]
    per = realtime.groupBy(F.col("asset_type").alias("name")).agg(F.count(F.lit(1)).alias("rows"), *span).withColumn(
        "section", F.lit("realtime"))
    busy = realtime.groupBy(F.col("symbol").alias("name")).agg(F.count(F.lit(1)).alias("rows"), *span).withColumn(
        "section", F.lit("most_active")).orderBy(F.col("rows").desc(), "name").limit(k)
    return out.unionByName(per, allowMissingColumns=True).unionByName(busy, allowMissingColumns=True)
