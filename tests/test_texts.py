"""Bands at their bounds, profiles out of JSON, previews, the log's header and whole briefings, against values written by hand."""

import datetime as dt

import frames
from pyspark.sql import functions as F

from pricelens.operators import report as P
from pricelens.operators import signals as G
from pricelens.operators import summary as M
from pricelens.plans import catalog
from pricelens.sources.profile import parse_profiles


def test_indicator_bands_at_their_bounds(spark):
    cols = "rsi double, macd double, bb_position double, volume_ratio double, sma_50 double, sma_200 double, stoch_k double"
    rows = [(70.0, 0.0, 0.8, 1.5, 2.0, 2.0, 80.0), (70.5, 0.1, 0.81, 1.6, 2.1, 2.0, 81.0), (29.9, -1.0, 0.1, 0.6, 1.0, 2.0, 19.0), (30.0, 0.0, 0.2, 0.7, 2.0, 2.0, 20.0), (None,) * 7]
    got = [tuple(r)[7:] for r in G.indicator_bands(spark.createDataFrame(rows, cols)).collect()]
    middle = ("NEUTRAL", "BEARISH", "MID RANGE", "NORMAL", "DEATH CROSS", "NEUTRAL")
    assert got == [middle, ("OVERBOUGHT", "BULLISH", "UPPER BAND", "HIGH VOLUME", "GOLDEN CROSS", "OVERBOUGHT"),
                   ("OVERSOLD", "BEARISH", "LOWER BAND", "LOW VOLUME", "DEATH CROSS", "OVERSOLD"), middle, middle]


def test_risk_bands_at_their_bounds(spark):
    d = spark.createDataFrame([("a", 1.0, 35.0, -40.0), ("b", 1.1, 36.0, -41.0), ("c", 0.0, 22.0, -25.0), ("d", None, None, None)],
                              "ticker string, sharpe double, annual_volatility double, max_drawdown double")
    assert {r.ticker: tuple(r)[1:] for r in G.risk_bands(d).collect()} == {
        "a": ("FAIR", "ELEVATED", "MODERATE"), "b": ("GOOD", "HIGH", "SEVERE"), "c": ("POOR", "LOW", "MILD"), "d": ("POOR", "LOW", "MILD")}


def test_every_band_is_reached(spark):
    d = catalog.QUERIES["board_bands"](spark, frames.SF001)
    n = d.agg(*[F.count_distinct(c).alias(c) for c in d.columns if c != "state_id"]).first().asDict()
    assert n == {"rsi_band": 3, "macd_band": 2, "bb_band": 3, "volume_band": 3, "trend": 2, "stoch_band": 3, "sharpe_band": 3, "vol_band": 3, "dd_band": 3,
                 "confidence_text": 3, "age_band": 3, "cap_size": 3}


def test_profiles_take_numbers_only_where_json_has_numbers(spark):
    texts = ['{"longName": "A", "x": 12, "sector": "S", "y": -2.5e-3}', '{"x": "12", "sector": null, "y": true}', '{"sector": 7, "x": null, "y": [1]}', "[1]", "", None, '{"x": 1']
    d = spark.createDataFrame(list(enumerate(texts)), "k int, props string")
    got = {r.k: (r.valid, r.longName, r.sector, r.x, r.y) for r in parse_profiles(d, ["x", "y"]).collect()}
    none = (False, None, "Unknown", None, None)
    assert got == {0: (True, "A", "S", 12.0, -0.0025), 1: (True, None, "Unknown", None, None), 2: (True, None, "Unknown", None, None), 3: none, 4: none, 5: none, 6: none}
    assert parse_profiles(d, ["x"], default=0.0).where("k > 0 and x = 0").count() == 6
    assert parse_profiles(d.where("false"), ["x"]).count() == 0


def test_preview_has_both_ends(spark):
    bars = frames.to_spark(spark, frames.series("A", [float(i) for i in range(1, 8)])).unionByName(frames.to_spark(spark, frames.series("B", [1.0, 2.0])))
    got = sorted((r.ticker, r.part, r.close) for r in M.preview(bars, 3).collect())
    assert got == [("A", "head", 1.0), ("A", "head", 2.0), ("A", "head", 3.0), ("A", "tail", 5.0), ("A", "tail", 6.0), ("A", "tail", 7.0),
                   ("B", "head", 1.0), ("B", "head", 2.0), ("B", "tail", 1.0), ("B", "tail", 2.0)]


def test_freshness(spark):
    t = dt.datetime(2024, 3, 10, 7, 5)
    d = spark.createDataFrame([(1, t, 0.52345), (2, t - dt.timedelta(days=20), None), (3, None, 0.5)], "k int, retrained_at timestamp_ntz, accuracy double")
    got = {r.k: tuple(r)[3:] for r in P.freshness(d, F.lit("2024-03-11 08:00:00").cast("timestamp")).collect()}
    assert got == {1: ("2024-03-10", "2024-03-10 07:05 UTC", "1 day ago", "fresh", "52.3% acc", "52.34%"),
                   2: ("2024-02-19", "2024-02-19 07:05 UTC", "3 weeks ago", "ageing", "accuracy n/a", "n/a"), 3: ("\u2014", "unknown", "unknown", "stale", "50.0% acc", "50.00%")}


def test_briefing_with_and_without_parts(spark):
    one = lambda cols, *row: spark.createDataFrame([row], f"ticker string, {cols}")
    risk = one("annual_return double, annual_volatility double, sharpe double, sortino double, max_drawdown double, positive_days double", "A", 1.25, 20.0, -0.125, None, -33.33, 51.0)
    got = P.briefing(spark.createDataFrame([("A",), ("B",)], "ticker string"), one("profile string", "A", "COMPANY: a"), one("direction string, confidence double", "A", "UP", 55.55),
                     one("importance_text string", "A", "  1. rsi"), one("returns_text string", "A", "1D: +0.1%"), risk, one("trend string", "A", "Trend: x"), one("digest string", "A", "- n"))
    texts = {r.ticker: r.briefing for r in got.collect()}
    assert texts["A"].split("\n") == [
        "TICKER: A", "COMPANY: a", "PREDICTION: UP", "CONFIDENCE: 55.5%", "INDICATOR IMPORTANCE & VALUES:", "  1. rsi", "HISTORICAL RETURNS:", "1D: +0.1%", "RISK METRICS:",
        "Annualised Return: 1.2%", "Annualised Volatility: 20.0%", "Sharpe Ratio: -0.12", "Sortino Ratio: 0.00", "Max Drawdown: -33.3%", "Positive Days: 51.0%", "TREND SIGNALS:", "Trend: x", "RECENT NEWS:", "- n"]
    assert texts["B"].split("\n") == [
        "TICKER: B", "", "PREDICTION: N/A", "CONFIDENCE: N/A", "INDICATOR IMPORTANCE & VALUES:", "", "HISTORICAL RETURNS:", "", "RISK METRICS:", "Annualised Return: 0.0%",
        "Annualised Volatility: 0.0%", "Sharpe Ratio: 0.00", "Sortino Ratio: 0.00", "Max Drawdown: 0.0%", "Positive Days: 0.0%", "TREND SIGNALS:", "", "RECENT NEWS:", ""]
