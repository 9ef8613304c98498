"""Technical indicators for every ticker at once (DataFrame -> DataFrame).

Input: bars ``(ticker, ts, open, high, low, close, volume, ...)``. Each function
appends columns. Functions prepare the frame (``pos``/``blk``, see
``operators.windows``) when the caller has not, and drop those helpers again; the
bundles prepare once, so all their windows share one exchange and one sort.
Warm-up rows are null (full-window guard); divisions are null-safe.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.scalar import sdiv
from pricelens.operators.windows import (
    ewm_held, ewm_helpers, ewm_mean, ewm_partials, ewm_value, finish, prepare, prepared, rolling,
    running, series_window,
)

C = F.col


def series_op(fn):
    @functools.wraps(fn)
    def wrap(df: DataFrame, *a, **k) -> DataFrame:
        had = prepared(df)
        return finish(fn(prepare(df), *a, **k), had)
    return wrap


@series_op
def daily_return(df: DataFrame, src: str = "close", out: str = "daily_return") -> DataFrame:
    """Percent change from the previous bar (W2)."""
    prev = F.lag(src).over(series_window())
    return df.withColumn(out, sdiv(C(src), prev) - 1)


@series_op
def diff(df: DataFrame, src: str = "close", out: str = "diff") -> DataFrame:
    """First difference (W1)."""
    return df.withColumn(out, C(src) - F.lag(src).over(series_window()))


@series_op
def lag_col(df: DataFrame, n: int = 1, src: str = "close", out: str | None = None) -> DataFrame:
    """Value ``n`` bars back (W7)."""
    return df.withColumn(out or f"{src}_lag{n}", F.lag(src, n).over(series_window()))


@series_op
def sma_set(df: DataFrame, periods=(50, 200), src: str = "close") -> DataFrame:
    """Simple moving averages (W3, W15)."""
    return df.withColumns({f"sma_{n}": rolling(src, n, "mean") for n in periods})


@series_op
def rsi(df: DataFrame, period: int = 14, src: str = "close", out: str = "rsi") -> DataFrame:
    """RSI with simple means of gains and losses (not Wilder smoothing).

    The first difference is null and counts as a zero gain and zero loss, so the
    value is defined from row ``period - 1``. Average loss 0 gives 100 when there
    was any gain and null when there was no move at all.
    """
    delta = C(src) - F.lag(src).over(series_window())
    gain = F.when(delta > 0, delta).otherwise(F.lit(0.0))
    loss = F.when(delta < 0, -delta).otherwise(F.lit(0.0))
    d = df.withColumns({"__gain": gain, "__loss": loss})
    d = d.withColumns({"__ag": rolling("__gain", period), "__al": rolling("__loss", period)})
    return d.withColumn(out, _rsi_value(C("__ag"), C("__al"))).drop("__gain", "__loss", "__ag", "__al")


@series_op
def ewm(df: DataFrame, span: float, src: str = "close", out: str | None = None) -> DataFrame:
    """EWM mean, adjust=True (W9, W16)."""
    return ewm_mean(df, src, out or f"ema_{int(span)}", span)


@series_op
def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9,
         src: str = "close") -> DataFrame:
    """MACD line = EWM(fast) - EWM(slow); signal = EWM(signal) of the line; hist = line - signal."""
    d = ewm_mean(df, src, "__ef", fast)
    d = ewm_mean(d, src, "__es", slow)
    d = d.withColumn("macd", C("__ef") - C("__es"))
    d = ewm_mean(d, "macd", "macd_signal", signal)
    return d.withColumn("macd_hist", C("macd") - C("macd_signal")).drop("__ef", "__es")


@series_op
def bollinger(df: DataFrame, period: int = 20, k: float = 2.0, src: str = "close") -> DataFrame:
    """Bollinger upper/lower (mean +- k sample std) and position of close in the band."""
    d = df.withColumns({"__m": rolling(src, period, "mean"), "__s": rolling(src, period, "std")})
    d = d.withColumns({"bb_upper": C("__m") + k * C("__s"), "bb_lower": C("__m") - k * C("__s")})
    d = d.withColumn("bb_position", sdiv(C(src) - C("bb_lower"), C("bb_upper") - C("bb_lower")))
    return d.drop("__m", "__s")


@series_op
def atr(df: DataFrame, period: int = 14) -> DataFrame:
    """Average true range, simple mean; the first true range is high - low."""
    pc = F.lag("close").over(series_window())
    tr = F.greatest(C("high") - C("low"), F.abs(C("high") - pc), F.abs(C("low") - pc))
    return df.withColumn("__tr", tr).withColumn("atr", rolling("__tr", period)).drop("__tr")


@series_op
def stochastic(df: DataFrame, period: int = 14, smooth: int = 3) -> DataFrame:
    """%K = 100 (close - min low) / (max high - min low) over ``period``; %D = mean of %K."""
    lo = rolling("low", period, "min")
    hi = rolling("high", period, "max")
    d = df.withColumn("stoch_k", F.lit(100.0) * sdiv(C("close") - lo, hi - lo))
    return d.withColumn("stoch_d", rolling("stoch_k", smooth))


@series_op
def drawdown(df: DataFrame, src: str = "close", out: str = "drawdown") -> DataFrame:
    """Percent below the running peak (<= 0)."""
    peak = F.max(src).over(running())
    return df.withColumn(out, sdiv(C(src) - peak, peak) * 100)


@series_op
def volume_ratio(df: DataFrame, period: int = 20) -> DataFrame:
    """Volume over its trailing mean."""
    return df.withColumn("volume_ratio", sdiv(C("volume"), rolling("volume", period)))


@series_op
def volatility(df: DataFrame, period: int = 30, src: str = "close") -> DataFrame:
    """Sample std of daily returns over ``period`` returns."""
    had = "daily_return" in df.columns
    d = df if had else daily_return(df, src)
    d = d.withColumn("volatility", rolling("daily_return", period, "std"))
    return d if had else d.drop("daily_return")


@series_op
def growth_curve(df: DataFrame, base: float = 10000.0, src: str = "close") -> DataFrame:
    """Value of ``base`` invested at the first bar."""
    first = F.first(src).over(running())
    return df.withColumn("growth", sdiv(C(src), first) * base)


@series_op
def add_label(df: DataFrame, horizon: int = 30, label_mode: str = "strict",
              src: str = "close") -> DataFrame:
    """Forward return over ``horizon`` bars and direction label.

    ``strict``: unresolved tail rows get a null label (dropped later).
    ``compat``: unresolved rows are labelled 0 (DOWN), as a `NaN > 0` test does.
    """
    fut = F.lead(src, horizon).over(series_window())
    d = df.withColumn("future_return", sdiv(fut, C(src)) - 1)
    up = (C("future_return") > 0).cast("int")
    if label_mode == "compat":
        up = F.coalesce(up, F.lit(0))
    return d.withColumn("target", up)


def _rsi_value(ag, al):
    return (F.when(al == 0, F.when(ag > 0, F.lit(100.0)))
            .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + sdiv(ag, al))))


def _bundle(df: DataFrame, full: bool) -> DataFrame:
    """All indicators in a few window levels sharing one sort (ticker, blk, pos).

    Level 1: lags and rolling windows of the raw columns;
    level 1b: EWM partial sums of close; level 2: windows over level-1 outputs
    (RSI means, volatility, ATR, %D) and the EWM values; level 3/4: MACD signal.
    """
    w = series_window()
    prev = "__prev"
    l1 = {
        prev: F.lag("close").over(w),
        "sma_50": rolling("close", 50),
        "sma_200": rolling("close", 200),
        "__m20": rolling("close", 20),
        "__s20": rolling("close", 20, "std"),
        "__v20": rolling("volume", 20),
    }
    if full:
        l1.update({
            "__lo14": rolling("low", 14, "min"),
            "__hi14": rolling("high", 14, "max"),
            "__peak": F.max("close").over(running()),
        })
    d = df.withColumns(l1)
    spans = {"__e12": 12, "__e26": 26}
    if full:
        spans["__e20"] = 20
    parts = {}
    for tag, sp in spans.items():
        parts.update(ewm_partials("close", tag, sp))
    d = d.withColumns(parts)
    delta = C("close") - C(prev)
    d = d.withColumns({
        "__gain": F.when(delta > 0, delta).otherwise(F.lit(0.0)),
        "__loss": F.when(delta < 0, -delta).otherwise(F.lit(0.0)),
        "daily_return": sdiv(C("close"), C(prev)) - 1,
        "bb_upper": C("__m20") + 2.0 * C("__s20"),
        "bb_lower": C("__m20") - 2.0 * C("__s20"),
        "volume_ratio": sdiv(C("volume"), C("__v20")),
    })
    d = d.withColumn("bb_position",
                     sdiv(C("close") - C("bb_lower"), C("bb_upper") - C("bb_lower")))
    if full:
        tr = F.greatest(C("high") - C("low"), F.abs(C("high") - C(prev)),
                        F.abs(C("low") - C(prev)))
        d = d.withColumns({
            "__tr": tr,
            "stoch_k": F.lit(100.0) * sdiv(C("close") - C("__lo14"), C("__hi14") - C("__lo14")),
            "drawdown": sdiv(C("close") - C("__peak"), C("__peak")) * 100,
        })
    l2 = {
        "__ag": rolling("__gain", 14),
        "__al": rolling("__loss", 14),
        "volatility": rolling("daily_return", 30, "std"),
    }
    for tag, sp in spans.items():
        l2[tag] = ewm_value(tag, sp)
    if full:
        l2["atr"] = rolling("__tr", 14)
        l2["stoch_d"] = rolling("stoch_k", 3)
    d = d.withColumns(l2)
    d = d.withColumns({tag: ewm_held(tag, "close") for tag in spans})
    d = d.withColumns({"rsi": _rsi_value(C("__ag"), C("__al")),
                       "macd": C("__e12") - C("__e26")})
    if full:
        d = d.withColumnRenamed("__e20", "ema_20")
    d = d.withColumns(ewm_partials("macd", "__sig", 9))
    d = d.withColumn("macd_signal", ewm_value("__sig", 9))
    d = d.withColumn("macd_signal", ewm_held("macd_signal", "macd"))
    d = d.withColumn("macd_hist", C("macd") - C("macd_signal"))
    helpers = [prev, "__m20", "__s20", "__v20", "__lo14", "__hi14", "__peak", "__gain", "__loss",
               "__tr", "__ag", "__al", "__e12", "__e26", "__e20"]
    for tag in list(spans) + ["__sig"]:
        helpers += ewm_helpers(tag)
    d = d.drop(*[h for h in helpers if h in d.columns])
    core = ["rsi", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "bb_position",
            "sma_50", "sma_200", "volume_ratio", "volatility", "daily_return"]
    extra = ["ema_20", "atr", "stoch_k", "stoch_d", "drawdown"] if full else []
    base = [c for c in df.columns if c not in core + extra]
    return d.select(*base, *core, *extra)


@series_op
def indicators_core(df: DataFrame) -> DataFrame:
    """The training indicator set: RSI, MACD(+signal, hist), Bollinger, SMA 50/200,
    volume ratio, volatility, daily return."""
    return _bundle(df, full=False)


@series_op
def indicators_full(df: DataFrame) -> DataFrame:
    """The analysis set: core plus EMA 20, ATR, stochastic and drawdown."""
    return _bundle(df, full=True)
