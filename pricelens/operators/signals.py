"""Display bands and buckets (fixed thresholds of the reference, as values)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col

# Cap-size thresholds (market cap in currency units).
CAP_LARGE = 200e9
CAP_MID = 10e9


def cap_bucket(df: DataFrame, col: str = "market_cap") -> DataFrame:
    return df.withColumn("cap_size", F.when(C(col) > CAP_LARGE, "Large")
                         .when(C(col) > CAP_MID, "Mid").otherwise("Small"))


def risk_columns() -> dict[str, F.Column]:
    """Sharpe > 1 GOOD / > 0 FAIR / POOR; volatility > 35 HIGH / > 22 ELEVATED / LOW;
    max drawdown < -40 SEVERE / < -25 MODERATE / MILD."""
    return {
        "sharpe_band": F.when(C("sharpe") > 1, "GOOD").when(C("sharpe") > 0, "FAIR").otherwise("POOR"),
        "vol_band": F.when(C("annual_volatility") > 35, "HIGH").when(C("annual_volatility") > 22, "ELEVATED").otherwise("LOW"),
        "dd_band": F.when(C("max_drawdown") < -40, "SEVERE").when(C("max_drawdown") < -25, "MODERATE").otherwise("MILD")}


def risk_bands(risk: DataFrame) -> DataFrame:
    """The bands of each ticker's risk metrics (:func:`risk_columns`)."""
    return risk.select("ticker", *[c.alias(n) for n, c in risk_columns().items()])


def confidence_text(conf_pct) -> F.Column:
    """Confidence wording: > 60 high, > 55 moderate, else low."""
    c = conf_pct if not isinstance(conf_pct, str) else C(conf_pct)
    return F.when(c > 60, "high").when(c > 55, "moderate").otherwise("low")


def staleness(age_days) -> F.Column:
    """< 14 days fresh, < 60 ageing, else stale."""
    a = age_days if not isinstance(age_days, str) else C(age_days)
    return F.when(a < 14, "fresh").when(a < 60, "ageing").otherwise("stale")


def _band(c: str, high: float, low: float, above: str, below: str, between: str) -> F.Column:
    return F.when(C(c) > high, above).when(C(c) < low, below).otherwise(between)


def indicator_bands(df: DataFrame) -> DataFrame:
    """The display bands of a bar's indicators, added to its columns. A bound belongs to the middle band, and a missing
    value does too; MACD and the averages have two bands, the lower one for equal or missing values."""
    return df.withColumns({
        "rsi_band": _band("rsi", 70, 30, "OVERBOUGHT", "OVERSOLD", "NEUTRAL"),
        "macd_band": F.when(C("macd") > 0, "BULLISH").otherwise("BEARISH"),
        "bb_band": _band("bb_position", 0.8, 0.2, "UPPER BAND", "LOWER BAND", "MID RANGE"),
        "volume_band": _band("volume_ratio", 1.5, 0.7, "HIGH VOLUME", "LOW VOLUME", "NORMAL"),
        "trend": F.when(C("sma_50") > C("sma_200"), "GOLDEN CROSS").otherwise("DEATH CROSS"),
        "stoch_band": _band("stoch_k", 80, 20, "OVERBOUGHT", "OVERSOLD", "NEUTRAL")})
