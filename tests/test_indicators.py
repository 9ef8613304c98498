"""Spark indicators against their definitions, evaluated place by place, on hand-made series."""

import math

import numpy as np
import pandas as pd
import pytest

from frames import series, to_spark, walk
from pricelens.operators import indicators as I


def frame(xs, i, n):
    """The n values up to place i, or None unless all are there."""
    own = xs[i - n + 1:i + 1] if i >= n - 1 else []
    return own if own and None not in own else None


def over(xs, n, fn):
    return [fn(w) if (w := frame(xs, i, n)) else None for i in range(len(xs))]


def average(w):
    return math.fsum(w) / len(w)


def deviation(w):
    m = average(w)
    return math.sqrt(math.fsum((x - m) ** 2 for x in w) / (len(w) - 1))


def decaying(xs, span):
    """Weighted mean of all observations so far; a weight shrinks by r at each place."""
    r, num, den, out = (span - 1) / (span + 1), 0.0, 0.0, []
    held = None
    for x in xs:
        num, den = num * r, den * r
        if x is not None:
            num, den = num + x, den + 1
            held = num / den
        out.append(held)
    return out


def both(xs, ys, fn):
    return [None if x is None or y is None else fn(x, y) for x, y in zip(xs, ys)]


def ratio(x, y):
    return x / y if y else None


def expected(pdf: pd.DataFrame) -> pd.DataFrame:
    """The indicators by their definitions, place by place over plain lists (None: no value)."""
    out = []
    for _, g in pdf.groupby("ticker", sort=False):
        g = g.sort_values("ts").copy()
        o = {}
        close, high, low, vol = ([None if pd.isna(v) else float(v) for v in g[c]] for c in ("close", "high", "low", "volume"))
        before = [None, *close[:-1]]
        step = both(close, before, lambda x, y: x - y)
        rise = over([max(d or 0.0, 0.0) for d in step], 14, average)
        fall = over([max(-(d or 0.0), 0.0) for d in step], 14, average)
        o["rsi"] = both(rise, fall, lambda u, d: ratio(100 * u, u + d))
        o["macd"] = both(decaying(close, 12), decaying(close, 26), lambda x, y: x - y)
        o["macd_signal"] = decaying(o["macd"], 9)
        o["macd_hist"] = both(o["macd"], o["macd_signal"], lambda x, y: x - y)
        middle, width = over(close, 20, average), over(close, 20, deviation)
        o["bb_upper"] = both(middle, width, lambda m, d: m + 2 * d)
        o["bb_lower"] = both(middle, width, lambda m, d: m - 2 * d)
        above = both(close, o["bb_lower"], lambda x, y: x - y)
        o["bb_position"] = both(above, width, lambda x, d: ratio(x, 4 * d))
        o["sma_50"], o["sma_200"] = over(close, 50, average), over(close, 200, average)
        o["volume_ratio"] = both(vol, over(vol, 20, average), ratio)
        o["daily_return"] = both(step, before, ratio)
        o["volatility"] = over(o["daily_return"], 30, deviation)
        o["ema_20"] = decaying(close, 20)
        reach = [max(abs(a - b) for a, b in ((h, lo), (h, p), (lo, p)) if None not in (a, b)) for h, lo, p in zip(high, low, before)]
        o["atr"] = over(reach, 14, average)
        floor, top = over(low, 14, min), over(high, 14, max)
        span = both(top, floor, lambda x, y: x - y)
        o["stoch_k"] = both(both(close, floor, lambda x, y: 100 * (x - y)), span, ratio)
        o["stoch_d"] = over(o["stoch_k"], 3, average)
        o["drawdown"] = [None if x is None else 100 * (x / max(y for y in close[:i + 1] if y is not None) - 1) for i, x in enumerate(close)]
        for name, values in o.items():
            g[name] = np.array([np.nan if v is None else v for v in values])
        out.append(g)
    return pd.concat(out)


COLS = ["rsi", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "bb_position", "sma_50",
        "sma_200", "volume_ratio", "volatility", "daily_return", "ema_20", "atr", "stoch_k",
        "stoch_d", "drawdown"]


def check(spark, pdf, cols=COLS, rtol=1e-9, atol=1e-7):
    got = I.indicators_full(to_spark(spark, pdf)).toPandas().sort_values(["ticker", "ts"])
    exp = expected(pdf).sort_values(["ticker", "ts"])
    for c in cols:
        a = got[c].astype(float).to_numpy()
        b = exp[c].astype(float).to_numpy()
        assert np.array_equal(np.isnan(a), np.isnan(b)), f"{c}: null pattern differs"
        m = ~np.isnan(a)
        np.testing.assert_allclose(a[m], b[m], rtol=rtol, atol=atol, err_msg=c)
    return got


def test_random_walks_two_tickers_shuffled(spark):
    pdf = pd.concat([walk("A", 420, 1), walk("B", 260, 2)]).sample(frac=1.0, random_state=3)
    check(spark, pdf)


def test_long_walk_ewm_no_overflow(spark):
    pdf = walk("L", 5000, 7, start=1e5)
    got = check(spark, pdf, cols=["macd", "macd_signal", "macd_hist", "ema_20"], rtol=1e-8, atol=1e-6)
    assert got["macd"].notna().all()


def test_flat_series(spark):
    pdf = series("F", [50.0] * 60)
    got = I.indicators_full(to_spark(spark, pdf)).toPandas()
    assert got["rsi"].isna().all()                # 0/0
    assert got["bb_position"].isna().all()        # zero-width band
    assert (got["volatility"].dropna() == 0).all()
    assert (got["drawdown"] == 0).all()
    assert (got["macd"].abs() < 1e-9).all()


def test_rising_and_falling(spark):
    up = series("U", [float(i + 1) for i in range(60)])
    dn = series("D", [float(100 - i) for i in range(60)])
    got = I.indicators_full(to_spark(spark, pd.concat([up, dn]))).toPandas()
    u, d = got[got.ticker == "U"].sort_values("ts"), got[got.ticker == "D"].sort_values("ts")
    assert (u["rsi"].dropna() == 100).all() and u["rsi"].notna().sum() == 60 - 13
    assert (d["rsi"].dropna() == 0).all()
    assert (u["drawdown"] == 0).all()
    assert d["drawdown"].iloc[-1] == pytest.approx((41 - 100) / 100 * 100)


@pytest.mark.parametrize("n", [13, 14, 19, 20, 29, 30, 31, 199, 200, 201])
def test_warmup_edges(spark, n):
    check(spark, walk("W", n, n))


def test_gap_nulls(spark):
    pdf = walk("G", 60, 5)
    pdf.loc[[25, 26], "close"] = None
    got = I.indicators_full(to_spark(spark, pdf)).toPandas().sort_values("ts")
    # full-window guard: every 20-bar window touching a null is null
    assert got["bb_upper"].iloc[25:46].isna().all()
    assert got["bb_upper"].iloc[46:].notna().all()


def test_zero_volume(spark):
    pdf = series("Z", [float(10 + i % 3) for i in range(40)], volumes=[0.0] * 40)
    got = I.indicators_full(to_spark(spark, pdf)).toPandas()
    assert got["volume_ratio"].isna().all()


def test_invariants(spark):
    pdf = pd.concat([walk("A", 300, 11), walk("B", 300, 12)])
    g = I.indicators_full(to_spark(spark, pdf)).toPandas()
    assert g["rsi"].dropna().between(0, 100).all()
    assert g["stoch_k"].dropna().between(0, 100).all()
    assert (g["drawdown"] <= 0).all()
    np.testing.assert_allclose(g["macd_hist"], g["macd"] - g["macd_signal"], atol=1e-12)
    m = g["bb_upper"].notna()
    assert (g.loc[m, "bb_lower"] <= g.loc[m, "bb_upper"]).all()


def test_partitioning_independent(spark):
    pdf = pd.concat([walk("A", 300, 21), walk("B", 250, 22), walk("C", 120, 23)])
    a = I.indicators_full(to_spark(spark, pdf)).toPandas().sort_values(["ticker", "ts"])
    b = I.indicators_full(to_spark(spark, pdf).repartition(7)).toPandas().sort_values(["ticker", "ts"])
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))


@pytest.mark.parametrize("span", [1.5, 2, 3, 9, 60, 400])
def test_ewm_any_span(spark, span):
    pdf = walk("S", 1300, 9)
    pdf.loc[[5, 700], "close"] = None
    got = I.ewm(to_spark(spark, pdf), span, out="e").toPandas().sort_values("ts")
    exp = pdf.sort_values("ts")["close"].ewm(span=span).mean()
    np.testing.assert_allclose(got["e"].to_numpy(), exp.to_numpy(), rtol=1e-10)


@pytest.mark.parametrize("n", [5, 20, 40, 41, 50, 200])
def test_rolling_forgets_what_left_the_frame(spark, n):
    """One huge value long ago leaves no trace, whatever the length of the frame."""
    from pricelens.operators.windows import finish, prepare, rolling
    pdf = series("S", [1e17] + [10.0] * 300)
    d = prepare(to_spark(spark, pdf))
    got = finish(d.withColumn("m", rolling("close", n)), False).orderBy("ts").toPandas()["m"]
    assert got.iloc[:n - 1].isna().all() and (got.iloc[n:] == 10.0).all()


@pytest.mark.parametrize("span", [1.5, 9, 26, 400])
def test_ewm_holds_over_long_gaps(spark, span):
    """Nulls from row 100 on, and an observation after 1,900 of them."""
    pdf = walk("S", 2600, 4)
    pdf.loc[100:1999, "close"] = None
    pdf.loc[2300:, "close"] = None
    got = I.ewm(to_spark(spark, pdf), span, out="e").toPandas().sort_values("ts")["e"]
    want = decaying([None if pd.isna(c) else c for c in pdf["close"]], span)
    np.testing.assert_allclose(got.to_numpy(), np.array(want), rtol=1e-9)
    assert got.notna().all()
