"""Per-ticker summaries: latest change, multi-horizon returns, risk metrics,
growth, 52-week range position, return histogram, chart tail, counts.

All work on the bar series. Per-ticker aggregates after the series windows group
by the ticker the data is already hash-partitioned on, so they add no exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pricelens.functions.scalar import sdiv
from pricelens.operators import indicators as I
from pricelens.operators.windows import prepare, running, series_window

C = F.col

# Return horizons in bars back from the newest bar, in display order; YTD is
# computed separately (fixed values).
HORIZONS = [("1D", 1), ("1W", 5), ("1M", 21), ("3M", 63), ("6M", 126), ("YTD", None),
            ("1Y", 252), ("3Y", 756), ("5Y", 1260), ("10Y", 2520)]
RISK_FREE = 4.5
TRADING_DAYS = 252


def with_extent(df: DataFrame) -> DataFrame:
    """Add ``n_rows`` (bars in the ticker) and ``rpos`` (bars after this one)."""
    d = prepare(df)
    d = d.withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy("ticker")))
    return d.withColumn("rpos", C("n_rows") - 1 - C("pos"))


def latest_change(bars: DataFrame) -> DataFrame:
    """Newest and previous close per ticker and the day change in percent."""
    d = prepare(bars).withColumns({
        "prev_close": F.lag("close").over(series_window()),
        "__next": F.lead("pos").over(series_window())})
    d = d.where(C("__next").isNull())
    return d.select("ticker", "ts", "close", "prev_close",
                    (sdiv(C("close") - C("prev_close"), C("prev_close")) * 100).alias("day_change"))


def period_returns(bars: DataFrame) -> DataFrame:
    """Long form (ticker, horizon, horizon_order, ret_pct).

    A horizon of d bars exists when the ticker has more than d bars; YTD compares
    with the first close of the newest bar's calendar year and needs more than one
    bar in that year; a ticker with fewer than 2 bars has no returns at all.
    """
    d = with_extent(bars).withColumn("__last_ts", F.max("ts").over(Window.partitionBy("ticker")))
    days = [h for _, h in HORIZONS if h is not None]
    this_year = F.year("ts") == F.year("__last_ts")
    keep = C("rpos").isin([0] + days) | this_year
    d = d.where(keep)
    aggs = [F.max_by("close", "pos").alias("last"), F.max("n_rows").alias("n_rows"),
            F.min_by(F.when(this_year, C("close")), F.when(this_year, C("pos"))).alias("ytd_ref"),
            F.count(F.when(this_year, 1)).alias("ytd_n")]
    for label, h in HORIZONS:
        if h is not None:
            aggs.append(F.max(F.when(C("rpos") == h, C("close"))).alias(f"r_{label}"))
    g = d.groupBy("ticker").agg(*aggs)
    entries = []
    for i, (label, h) in enumerate(HORIZONS):
        ref = C("ytd_ref") if h is None else C(f"r_{label}")
        ok = (C("ytd_n") > 1) if h is None else (C("n_rows") > h)
        val = F.when(ok & (C("n_rows") >= 2), sdiv(C("last") - ref, ref) * 100)
        entries.append(F.struct(F.lit(label).alias("horizon"), F.lit(i + 1).alias("horizon_order"),
                                val.alias("ret_pct")))
    e = g.select("ticker", F.explode(F.array(*entries)).alias("e")).select("ticker", "e.*")
    return e.where(C("ret_pct").isNotNull())


def risk_metrics(bars: DataFrame, risk_free: float = RISK_FREE) -> DataFrame:
    """Annualised return/volatility, Sharpe, Sortino, max drawdown, positive days.

    Needs at least 30 daily returns (tickers with fewer are absent). Sortino uses the
    sample deviation of the negative returns (annual volatility when there are none;
    0 when that deviation is undefined or 0).
    """
    d = I.drawdown(I.daily_return(prepare(bars)))
    ret = C("daily_return")
    g = d.groupBy("ticker").agg(
        F.count(ret).alias("n_ret"),
        F.avg(ret).alias("mu"),
        F.stddev_samp(ret).alias("sd"),
        F.count(F.when(ret < 0, ret)).alias("n_neg"),
        F.stddev_samp(F.when(ret < 0, ret)).alias("sd_neg"),
        F.min("drawdown").alias("max_drawdown"),
        F.count(F.when(ret > 0, ret)).alias("n_pos"))
    g = g.where(C("n_ret") >= 30)
    ann = math.sqrt(TRADING_DAYS) * 100
    vol = C("sd") * ann
    annual_ret = C("mu") * TRADING_DAYS * 100
    down = F.when(C("n_neg") > 0, C("sd_neg") * ann).otherwise(vol)
    return g.select(
        "ticker",
        annual_ret.alias("annual_return"),
        vol.alias("annual_volatility"),
        F.when(vol > 0, (annual_ret - risk_free) / vol).otherwise(F.lit(0.0)).alias("sharpe"),
        F.when(down > 0, (annual_ret - risk_free) / down).otherwise(F.lit(0.0)).alias("sortino"),
        "max_drawdown",
        (C("n_pos") / C("n_ret") * 100).alias("positive_days"))


def growth_summary(bars: DataFrame, base: float = 10000.0) -> DataFrame:
    """Growth of ``base`` from the first to the newest close; years = days / 365.25."""
    g = bars.groupBy("ticker").agg(
        F.min_by("close", "ts").alias("first_close"), F.max_by("close", "ts").alias("last_close"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_bars"))
    return g.select(
        "ticker", "n_bars",
        (sdiv(C("last_close"), C("first_close")) * base).alias("final_value"),
        sdiv(C("last_close"), C("first_close")).alias("multiple"),
        (F.datediff(C("last_ts").cast("date"), C("first_ts").cast("date")) / 365.25).alias("years"))


def range_position(bars: DataFrame, lookback: int = 252) -> DataFrame:
    """Position of the newest close in the low/high range of the last ``lookback`` bars
    (in percent), with the range guarded by max(high - low, 1e-9)."""
    d = with_extent(bars).where(C("rpos") < lookback)
    g = d.groupBy("ticker").agg(F.min("low").alias("low_52w"), F.max("high").alias("high_52w"),
                                F.max_by("close", "pos").alias("price"))
    lo = F.coalesce(C("low_52w"), F.lit(0.0))
    hi = F.coalesce(C("high_52w"), F.lit(1.0))
    return g.select("ticker", "price", "low_52w", "high_52w",
                    ((C("price") - lo) / F.greatest(hi - lo, F.lit(1e-9)) * 100).alias("range_pct"))


def return_histogram(bars: DataFrame, bins: int = 80) -> DataFrame:
    """Equal-width histogram of daily returns (percent) per ticker, ``bins`` buckets
    between the ticker's min and max; the maximum falls in the last bucket."""
    d = I.daily_return(prepare(bars)).where(C("daily_return").isNotNull())
    d = d.withColumn("r", C("daily_return") * 100)
    p = Window.partitionBy("ticker")
    d = d.withColumns({"mn": F.min("r").over(p), "mx": F.max("r").over(p)})
    b = F.least(F.floor(sdiv(C("r") - C("mn"), C("mx") - C("mn")) * bins) + 1, F.lit(bins))
    d = d.withColumn("bucket", F.coalesce(b, F.lit(1)).cast("int"))
    return d.groupBy("ticker", "bucket").agg(
        F.count("*").alias("n"), F.first("mn").alias("mn"), F.first("mx").alias("mx")).select(
        "ticker", "bucket", "n",
        (C("mn") + (C("bucket") - 1) * (C("mx") - C("mn")) / bins).alias("lo_edge"))


def chart_tail(bars: DataFrame, n: int = 63) -> DataFrame:
    """The newest ``n`` bars of each ticker (a chart window)."""
    return with_extent(bars).where(C("rpos") < n).drop("pos", "blk", "n_rows", "rpos")


def preview(bars: DataFrame, n: int = 5) -> DataFrame:
    """The first and the newest ``n`` bars of each ticker; ``part`` is 'head' or 'tail', a bar that is in both has a row for each."""
    parts = F.array_compact(F.array(F.when(C("pos") < n, "head"), F.when(C("rpos") < n, "tail")))
    return with_extent(bars).where((C("pos") < n) | (C("rpos") < n)).withColumn("part", F.explode(parts)).drop("blk", "n_rows", "rpos")


def bar_direction(df: DataFrame) -> DataFrame:
    """Direction flags per bar: close >= open, MACD histogram >= 0, return >= 0."""
    return df.withColumns({
        "up_bar": C("close") >= C("open"),
        "hist_up": C("macd_hist") >= 0,
        "ret_up": C("daily_return") >= 0,
    })
