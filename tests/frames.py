"""Hand-made bar frames (see FIXTURES.md section 4)."""

import datetime as dt

import numpy as np
import pandas as pd

SF001 = "/root/testdata/sf0.001"
T0 = dt.datetime(2020, 1, 1)


def series(ticker, closes, highs=None, lows=None, volumes=None, opens=None):
    n = len(closes)
    closes = [None if (c is None or (isinstance(c, float) and np.isnan(c))) else float(c) for c in closes]
    highs = highs or [None if c is None else c + 1.0 for c in closes]
    lows = lows or [None if c is None else c - 1.0 for c in closes]
    opens = opens or closes
    volumes = volumes or [100.0 + (i % 7) * 10 for i in range(n)]
    return pd.DataFrame({
        "ticker": ticker, "sector": "S", "ts": [T0 + dt.timedelta(days=i) for i in range(n)],
        "open": opens, "high": highs, "low": lows, "close": closes,
        "volume": [float(v) for v in volumes]})


def walk(ticker, n, seed=0, start=100.0):
    r = np.random.default_rng(seed)
    c = start * np.exp(np.cumsum(r.normal(0, 0.02, n)))
    c = np.round(c, 2)
    h = np.round(c * (1 + np.abs(r.normal(0, 0.01, n))), 2)
    lo = np.round(c * (1 - np.abs(r.normal(0, 0.01, n))), 2)
    v = np.round(r.uniform(50, 500, n))
    return series(ticker, list(c), list(h), list(lo), list(v))


BARS_SCHEMA = ("ticker string, sector string, ts timestamp_ntz, open double, high double, "
               "low double, close double, volume double")


def to_spark(spark, pdf):
    """As ingest does: NaN never enters a frame (it becomes null)."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(pdf, BARS_SCHEMA)
    num = ["open", "high", "low", "close", "volume"]
    return df.select("ticker", "sector", "ts",
                     *[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) for c in num])
