"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the SQL oracle
for each value-checked one. Every query reads the shared test tables (or views
Spark derives from them) in full.

Float outputs are rounded identically on both sides: price-scale values with a
generic (non-terminating) result to 2 decimals, ratios to 4-8, exact-decimal
results (means of 2-decimal prices) to 6 so no rounding tie can occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.operators import indicators as I
from pricelens.operators.windows import prepare, series_window
from pricelens.plans import sql as S
from pricelens.session import ensure_checkpoint_dir
from pricelens.sources import derived as D
from pricelens.sources.bars import restrict_period

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

C = F.col


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rnd(df: DataFrame, spec: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(C(c), n) for c, n in spec.items()})


def rsql(spec: dict[str, int]) -> str:
    return ", ".join(f"round({c}, {n}) AS {c}" for c, n in spec.items())


# Output precision per indicator column.
IND_ROUND = {
    "rsi": 4, "macd": 2, "macd_signal": 2, "macd_hist": 2, "bb_upper": 2, "bb_lower": 2,
    "bb_position": 6, "sma_50": 6, "sma_200": 6, "volume_ratio": 6, "volatility": 6,
    "daily_return": 8, "ema_20": 2, "atr": 4, "stoch_k": 4, "stoch_d": 4, "drawdown": 6,
}
CORE_COLS = ["rsi", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "bb_position",
             "sma_50", "sma_200", "volume_ratio", "volatility", "daily_return"]
FULL_COLS = CORE_COLS + ["ema_20", "atr", "stoch_k", "stoch_d", "drawdown"]
IND_SQL = S.with_(S.BARS, *S.INDICATORS, recursive=True)


def _sel(cols):
    return {c: IND_ROUND[c] for c in cols}


# --------------------------------------------------------------------------- sources
@register("bars_daily", S.with_(S.BARS) + """
SELECT ticker, sector, ts, open, high, low, close, volume FROM bars""")
def q_bars_daily(spark, sf):
    return D.bars(spark, sf)


@register("bars_period", S.with_(S.BARS) + """,
mx AS (SELECT *, max(ts) OVER (PARTITION BY ticker) AS last_ts FROM bars),
per AS (SELECT * FROM mx WHERE ts >= last_ts - INTERVAL 3 YEAR)
SELECT ticker, ts, close,
       round(CASE WHEN count(close) OVER w = 50 THEN avg(close) OVER w END, 6) AS sma_50
FROM per WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def q_bars_period(spark, sf):
    b = restrict_period(D.bars(spark, sf), 3)
    return rnd(I.sma_set(b, (50,)).select("ticker", "ts", "close", "sma_50"), {"sma_50": 6})


@register("event_bars", S.with_(S.EVENT_BARS) + """
SELECT ticker, ts, open, high, low, close, volume FROM ebars""")
def q_event_bars(spark, sf):
    return D.event_bars(spark, sf)


@register("universe_counts", """
SELECT r_name AS sector, count(*) AS n_tickers, list_sort(list(n_name)) AS tickers
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def q_universe_counts(spark, sf):
    u = D.universe_map(spark, sf)
    e = u.select(F.explode("universe").alias("sector", "tickers"))
    return e.select("sector", F.size("tickers").cast("long").alias("n_tickers"), "tickers")


# --------------------------------------------------------------------------- indicators
@register("indicators_core", IND_SQL + f"""
SELECT ticker, ts, {rsql(_sel(CORE_COLS))} FROM ind""")
def q_indicators_core(spark, sf):
    d = I.indicators_core(D.bars(spark, sf))
    return rnd(d.select("ticker", "ts", *CORE_COLS), _sel(CORE_COLS))


@register("indicators_full", IND_SQL + f"""
SELECT ticker, ts, {rsql(_sel(FULL_COLS))} FROM ind""")
def q_indicators_full(spark, sf):
    d = I.indicators_full(D.bars(spark, sf))
    return rnd(d.select("ticker", "ts", *FULL_COLS), _sel(FULL_COLS))


def _single(name, fn, cols):
    @register(name, IND_SQL + f"SELECT ticker, ts, {rsql(_sel(cols))} FROM ind")
    def q(spark, sf):
        d = fn(D.bars(spark, sf))
        return rnd(d.select("ticker", "ts", *cols), _sel(cols))
    q.__name__ = f"q_{name}"
    return q


_single("rsi", I.rsi, ["rsi"])
_single("macd", I.macd, ["macd", "macd_signal", "macd_hist"])
_single("ewm", lambda b: I.ewm(b, 20, out="ema_20"), ["ema_20"])
_single("bollinger", I.bollinger, ["bb_upper", "bb_lower", "bb_position"])
_single("atr", I.atr, ["atr"])
_single("stochastic", I.stochastic, ["stoch_k", "stoch_d"])
_single("sma_set", I.sma_set, ["sma_50", "sma_200"])
_single("volume_ratio", I.volume_ratio, ["volume_ratio"])
_single("volatility", lambda b: I.volatility(I.daily_return(b)), ["volatility", "daily_return"])
_single("drawdown", I.drawdown, ["drawdown"])


@register("growth_curve", S.with_(S.BARS) + """
SELECT ticker, ts, round(close / first(close) OVER (PARTITION BY ticker ORDER BY ts
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 10000, 4) AS growth
FROM bars""")
def q_growth_curve(spark, sf):
    return rnd(I.growth_curve(D.bars(spark, sf)).select("ticker", "ts", "growth"), {"growth": 4})


# --------------------------------------------------------------------------- signals
def _latest(d: DataFrame) -> DataFrame:
    """Newest bar of each ticker, found on the series window already in place."""
    d = prepare(d).withColumn("__next", F.lead("pos").over(series_window()))
    return d.where(C("__next").isNull()).drop("__next")


def signal_board(bars: DataFrame) -> DataFrame:
    """Technical state, at its newest bar, of every ticker with enough history (200 bars), with the display bands."""
    from pricelens.operators.labels import min_history
    from pricelens.operators.signals import indicator_bands
    d = indicator_bands(_latest(I.indicators_full(min_history(prepare(bars)))))
    return d.select("ticker", "sector", "ts", "close", F.round("rsi", 4).alias("rsi"),
                    "rsi_band", "macd_band", "bb_band", "volume_band", "trend", "stoch_band")


@register("signal_board", IND_SQL + """
SELECT ticker, sector, ts, close, round(rsi, 4) AS rsi,
       CASE WHEN rsi > 70 THEN 'OVERBOUGHT' WHEN rsi < 30 THEN 'OVERSOLD' ELSE 'NEUTRAL' END AS rsi_band,
       CASE WHEN macd > 0 THEN 'BULLISH' ELSE 'BEARISH' END AS macd_band,
       CASE WHEN bb_position > 0.8 THEN 'UPPER BAND' WHEN bb_position < 0.2 THEN 'LOWER BAND'
            ELSE 'MID RANGE' END AS bb_band,
       CASE WHEN volume_ratio > 1.5 THEN 'HIGH VOLUME' WHEN volume_ratio < 0.7 THEN 'LOW VOLUME'
            ELSE 'NORMAL' END AS volume_band,
       CASE WHEN sma_50 > sma_200 THEN 'GOLDEN CROSS' ELSE 'DEATH CROSS' END AS trend,
       CASE WHEN stoch_k > 80 THEN 'OVERBOUGHT' WHEN stoch_k < 20 THEN 'OVERSOLD' ELSE 'NEUTRAL' END AS stoch_band
FROM ind WHERE pos = n_rows - 1 AND n_rows >= 200""")
def q_signal_board(spark, sf):
    return signal_board(D.bars(spark, sf))


# --------------------------------------------------------------------------- summaries
from pricelens.operators import evaluate as E  # noqa: E402
from pricelens.operators import labels as L  # noqa: E402
from pricelens.operators import summary as M  # noqa: E402

BPS = S.with_(S.BARS, S.BP)


@register("latest_change", BPS + """,
lc AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS prev_close FROM bp)
SELECT ticker, ts, close, prev_close,
       round((close - prev_close) / prev_close * 100, 6) AS day_change
FROM lc WHERE pos = n_rows - 1""")
def q_latest_change(spark, sf):
    return rnd(M.latest_change(D.bars(spark, sf)), {"day_change": 6})


_HZ = ", ".join(f"('{h}', {i + 1}, {d if d is not None else 'NULL'})"
                for i, (h, d) in enumerate(M.HORIZONS))

PERIOD_RETURNS_SQL = BPS + f""",
h(horizon, horizon_order, days) AS (VALUES {_HZ}),
last AS (SELECT ticker, ts AS last_ts, close AS last_close, n_rows FROM bp WHERE pos = n_rows - 1),
ytd AS (SELECT b.ticker, arg_min(b.close, b.pos) AS ref, count(*) AS n_y
        FROM bp b JOIN last l ON b.ticker = l.ticker AND year(b.ts) = year(l.last_ts)
        GROUP BY b.ticker),
rets AS (
  SELECT l.ticker, h.horizon, h.horizon_order, (l.last_close - r.close) / r.close * 100 AS ret_pct
  FROM last l JOIN h ON h.days IS NOT NULL AND l.n_rows > h.days AND l.n_rows >= 2
  JOIN bp r ON r.ticker = l.ticker AND r.pos = l.n_rows - 1 - h.days
  UNION ALL
  SELECT l.ticker, 'YTD', 6, (l.last_close - y.ref) / y.ref * 100
  FROM last l JOIN ytd y ON l.ticker = y.ticker WHERE y.n_y > 1 AND l.n_rows >= 2)"""


@register("period_returns", PERIOD_RETURNS_SQL + """
SELECT ticker, horizon, horizon_order, round(ret_pct, 6) AS ret_pct FROM rets""")
def q_period_returns(spark, sf):
    return rnd(M.period_returns(D.bars(spark, sf)), {"ret_pct": 6})


RISK_SQL = BPS + """,
r AS (SELECT *, close / lag(close) OVER w - 1 AS ret,
             (close - max(close) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
               / max(close) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100 AS dd
      FROM bp WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
g AS (SELECT ticker, count(ret) AS n_ret, avg(ret) AS mu, stddev_samp(ret) AS sd,
             count(ret) FILTER (WHERE ret < 0) AS n_neg,
             stddev_samp(ret) FILTER (WHERE ret < 0) AS sd_neg,
             min(dd) AS max_drawdown, count(ret) FILTER (WHERE ret > 0) AS n_pos
      FROM r GROUP BY ticker HAVING count(ret) >= 30),
k AS (SELECT ticker, mu * 252 * 100 AS annual_return, sd * sqrt(252) * 100 AS annual_volatility,
             CASE WHEN n_neg > 0 THEN sd_neg * sqrt(252) * 100 ELSE sd * sqrt(252) * 100 END AS down,
             max_drawdown, n_pos::DOUBLE / n_ret * 100 AS positive_days FROM g),
risk AS (SELECT ticker, annual_return, annual_volatility,
       CASE WHEN annual_volatility > 0 THEN (annual_return - 4.5) / annual_volatility ELSE 0.0 END AS sharpe,
       CASE WHEN down > 0 THEN (annual_return - 4.5) / down ELSE 0.0 END AS sortino,
       max_drawdown, positive_days FROM k)"""
RISK_COLS = {"annual_return": 6, "annual_volatility": 6, "sharpe": 8, "sortino": 8,
             "max_drawdown": 6, "positive_days": 6}


@register("risk_metrics", RISK_SQL + f"\nSELECT ticker, {rsql(RISK_COLS)} FROM risk")
def q_risk_metrics(spark, sf):
    return rnd(M.risk_metrics(D.bars(spark, sf)), RISK_COLS)


@register("risk_bands", RISK_SQL + """
SELECT ticker,
  CASE WHEN sharpe > 1 THEN 'GOOD' WHEN sharpe > 0 THEN 'FAIR' ELSE 'POOR' END AS sharpe_band,
  CASE WHEN annual_volatility > 35 THEN 'HIGH' WHEN annual_volatility > 22 THEN 'ELEVATED' ELSE 'LOW' END AS vol_band,
  CASE WHEN max_drawdown < -40 THEN 'SEVERE' WHEN max_drawdown < -25 THEN 'MODERATE' ELSE 'MILD' END AS dd_band
FROM risk""")
def q_risk_bands(spark, sf):
    from pricelens.operators.signals import risk_bands
    return risk_bands(M.risk_metrics(D.bars(spark, sf)))


@register("growth_summary", S.with_(S.BARS) + """
SELECT ticker, count(*) AS n_bars,
       round(arg_max(close, ts) / arg_min(close, ts) * 10000, 4) AS final_value,
       round(arg_max(close, ts) / arg_min(close, ts), 8) AS multiple,
       round(datediff('day', min(ts)::DATE, max(ts)::DATE) / 365.25, 6) AS years
FROM bars GROUP BY ticker""")
def q_growth_summary(spark, sf):
    return rnd(M.growth_summary(D.bars(spark, sf)), {"final_value": 4, "multiple": 8, "years": 6})


@register("range_position", BPS + """,
t AS (SELECT ticker, min(low) AS low_52w, max(high) AS high_52w, arg_max(close, pos) AS price
      FROM bp WHERE n_rows - 1 - pos < 252 GROUP BY ticker)
SELECT ticker, price, low_52w, high_52w,
       round((price - coalesce(low_52w, 0)) / greatest(coalesce(high_52w, 1) - coalesce(low_52w, 0), 1e-9) * 100, 6) AS range_pct
FROM t""")
def q_range_position(spark, sf):
    return rnd(M.range_position(D.bars(spark, sf)), {"range_pct": 6})


@register("return_histogram", BPS + """,
r AS (SELECT ticker, (close / lag(close) OVER (PARTITION BY ticker ORDER BY ts) - 1) * 100 AS r FROM bp),
m AS (SELECT ticker, r, min(r) OVER (PARTITION BY ticker) AS mn, max(r) OVER (PARTITION BY ticker) AS mx
      FROM r WHERE r IS NOT NULL),
b AS (SELECT ticker, mn, mx,
             coalesce(least(floor((r - mn) / NULLIF(mx - mn, 0) * 80) + 1, 80), 1)::INTEGER AS bucket
      FROM m)
SELECT ticker, bucket, count(*) AS n, round(any_value(mn) + (bucket - 1) * (any_value(mx) - any_value(mn)) / 80, 6) AS lo_edge
FROM b GROUP BY ticker, bucket""")
def q_return_histogram(spark, sf):
    return rnd(M.return_histogram(D.bars(spark, sf)), {"lo_edge": 6})


@register("chart_tail", BPS + """
SELECT ticker, sector, ts, open, high, low, close, volume FROM bp WHERE n_rows - 1 - pos < 63""")
def q_chart_tail(spark, sf):
    return M.chart_tail(D.bars(spark, sf), 63)


@register("bar_direction", IND_SQL + """
SELECT ticker, count_if(close >= open) AS up_bars, count_if(macd_hist >= 0) AS hist_up,
       count_if(daily_return >= 0) AS ret_up, count(*) AS n_bars
FROM ind GROUP BY ticker""")
def q_bar_direction(spark, sf):
    d = M.bar_direction(I.indicators_core(D.bars(spark, sf)))
    return d.groupBy("ticker").agg(F.count_if("up_bar").alias("up_bars"),
                                   F.count_if("hist_up").alias("hist_up"),
                                   F.count_if("ret_up").alias("ret_up"),
                                   F.count("*").alias("n_bars"))


# --------------------------------------------------------------------------- labels, splits
TRAIN_SQL = S.with_(S.BARS, *S.TRAINING, recursive=True)


def training_frame(spark, sf, label_mode: str = "strict", bars: DataFrame | None = None) -> DataFrame:
    """bars -> core indicators -> 30-bar label (one plan, one ticker exchange; the
    frame keeps pos/blk so the split reuses the indicator sort)."""
    return I.add_label(I.indicators_core(prepare(D.bars(spark, sf) if bars is None else bars)), 30, label_mode)


def split_frame(spark, sf, bars: DataFrame | None = None) -> DataFrame:
    return L.embargo_split(L.usable_rows(training_frame(spark, sf, bars=bars)))


def kept_bars(spark, sf) -> DataFrame:
    """The bars, built from the ticks once and stored under the shared checkpoint folder, for a query that needs them
    in several parts: Spark reuses an exchange only within one job and one shape, and the ticks are what grows."""
    ensure_checkpoint_dir(spark)
    return D.bars(spark, sf).checkpoint(eager=True)


def preds_frame(spark, sf) -> DataFrame:
    """Test rows scored by the MACD-histogram rule (score = hist, UP when > 0)."""
    t = split_frame(spark, sf).where(C("part") == "test")
    return t.select("ticker", "sector", "ts", "target", C("macd_hist").alias("score"),
                    (C("macd_hist") > 0).cast("int").alias("prediction"))


@register("label_strict", S.with_(S.BARS, *S.INDICATORS, S.LABEL, recursive=True) + """
SELECT ticker, ts, round(future_return, 8) AS future_return, target FROM lab2""")
def q_label_strict(spark, sf):
    d = I.add_label(D.bars(spark, sf), 30, "strict")
    return rnd(d.select("ticker", "ts", "future_return", "target"), {"future_return": 8})


@register("label_compat", S.with_(S.BARS, *S.INDICATORS, S.LABEL, S.LABEL_COMPAT, recursive=True) + """
SELECT ticker, ts, round(future_return, 8) AS future_return, target_c AS target FROM labc""")
def q_label_compat(spark, sf):
    d = I.add_label(D.bars(spark, sf), 30, "compat")
    return rnd(d.select("ticker", "ts", "future_return", "target"), {"future_return": 8})


@register("min_history", S.with_(S.BARS) + """,
c AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM bars)
SELECT ticker, ts, close FROM c WHERE n >= 1000""")
def q_min_history(spark, sf):
    return L.min_history(D.bars(spark, sf), 1000).select("ticker", "ts", "close")


@register("usable_rows", TRAIN_SQL + """
SELECT ticker, count(*) AS usable FROM usable GROUP BY ticker""")
def q_usable_rows(spark, sf):
    return L.usable_rows(training_frame(spark, sf)).groupBy("ticker").agg(
        F.count("*").alias("usable"))


FEATURE_ROUND = {c: IND_ROUND[c] for c in ["rsi", "macd", "macd_hist", "bb_position",
                                             "volume_ratio", "volatility", "daily_return"]}


@register("feature_matrix", TRAIN_SQL + f"""
SELECT ticker, ts, {rsql(FEATURE_ROUND)}, target FROM usable""")
def q_feature_matrix(spark, sf):
    from pricelens.schema import FEATURES_7
    u = L.usable_rows(training_frame(spark, sf))
    return rnd(u.select("ticker", "ts", *FEATURES_7, "target"), FEATURE_ROUND)


@register("embargo_split", TRAIN_SQL + """
SELECT ticker, ts, ri AS row_in_ticker, part FROM parts""")
def q_embargo_split(spark, sf):
    return split_frame(spark, sf).select("ticker", "ts", "row_in_ticker", "part")


@register("split_global", TRAIN_SQL + """,
g AS (SELECT *, row_number() OVER (ORDER BY ticker, ts) - 1 AS global_pos,
             count(*) OVER () AS total FROM usable)
SELECT ticker, ts, global_pos,
       CASE WHEN global_pos < floor(total * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part
FROM g""")
def q_split_global(spark, sf):
    d = L.split_global(L.usable_rows(training_frame(spark, sf)))
    return d.select("ticker", "ts", "global_pos", "part")


@register("split_summary", TRAIN_SQL + """
SELECT part, count(*) AS rows, round(avg(target) * 100, 6) AS up_pct FROM parts GROUP BY part""")
def q_split_summary(spark, sf):
    return rnd(E.split_summary(split_frame(spark, sf)), {"up_pct": 6})


@register("rows_per_ticker", S.with_(S.BARS) + """
SELECT ticker, count(*) AS n_rows FROM bars GROUP BY ROLLUP (ticker)""")
def q_rows_per_ticker(spark, sf):
    return D.bars(spark, sf).rollup("ticker").agg(F.count("*").alias("n_rows"))


@register("sector_summary", S.with_(S.BARS) + """
SELECT sector, count(DISTINCT ticker) AS n_tickers, count(*) AS n_rows FROM bars GROUP BY sector""")
def q_sector_summary(spark, sf):
    return D.bars(spark, sf).groupBy("sector").agg(F.count_distinct("ticker").alias("n_tickers"),
                                                   F.count("*").alias("n_rows"))


@register("label_distribution", TRAIN_SQL + """
SELECT target, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share
FROM usable GROUP BY target""")
def q_label_distribution(spark, sf):
    u = L.usable_rows(training_frame(spark, sf))
    g = u.groupBy("target").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(C("n") / F.sum("n").over(Window.partitionBy()), 8))


# --------------------------------------------------------------------------- evaluation
PRED_SQL = S.with_(S.BARS, *S.TRAINING, S.PREDS, recursive=True)
BASE_SQL = S.with_(S.BARS, *S.TRAINING, S.BASE_PREDS, recursive=True)
EVAL_ROUND = {"accuracy": 8, "baseline_always_up_acc": 8, "lift_over_baseline_pp": 6,
              "down_precision": 8, "down_recall": 8, "down_f1": 8}


@register("eval_metrics", PRED_SQL + ", " + S.COUNTS + ", " + S.EVAL)
def q_eval_metrics(spark, sf):
    return rnd(E.eval_metrics(preds_frame(spark, sf)), EVAL_ROUND)


@register("baseline_eval", BASE_SQL + ", " + S.COUNTS + ", " + S.EVAL)
def q_baseline_eval(spark, sf):
    return rnd(E.eval_metrics(E.always_up(preds_frame(spark, sf))), EVAL_ROUND)


@register("confusion_matrix", PRED_SQL + ", " + S.COUNTS + "\nSELECT tn, fp, fn, tp FROM cm")
def q_confusion_matrix(spark, sf):
    return E.confusion_matrix(preds_frame(spark, sf))


@register("class_report", PRED_SQL + ", " + S.COUNTS + """,
cls AS (
  SELECT 'DOWN' AS label, coalesce(tn / NULLIF((tn + fn)::DOUBLE, 0), 0.0) AS precision,
         coalesce(tn / NULLIF((tn + fp)::DOUBLE, 0), 0.0) AS recall, (tn + fp)::DOUBLE AS support FROM cm
  UNION ALL
  SELECT 'UP', coalesce(tp / NULLIF((tp + fp)::DOUBLE, 0), 0.0),
         coalesce(tp / NULLIF((tp + fn)::DOUBLE, 0), 0.0), (tp + fn)::DOUBLE FROM cm),
f AS (SELECT *, coalesce(2 * precision * recall / NULLIF(precision + recall, 0), 0.0) AS f1 FROM cls),
allr AS (
  SELECT label, precision, recall, f1, support FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg',
     coalesce(sum(precision * support) / NULLIF(sum(support), 0), 0.0),
     coalesce(sum(recall * support) / NULLIF(sum(support), 0), 0.0),
     coalesce(sum(f1 * support) / NULLIF(sum(support), 0), 0.0), sum(support) FROM f)
SELECT label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1,
       support FROM allr""")
def q_class_report(spark, sf):
    return rnd(E.class_report(preds_frame(spark, sf)), {"precision": 8, "recall": 8, "f1": 8})


@register("roc_auc", PRED_SQL + """,
g AS (SELECT score, count_if(target = 1) AS pos, count_if(target = 0) AS neg FROM preds GROUP BY score),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0
             THEN sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) END, 10) AS roc_auc
FROM c""")
def q_roc_auc(spark, sf):
    return rnd(E.roc_auc(preds_frame(spark, sf)), {"roc_auc": 10})


@register("sector_accuracy", PRED_SQL + """
SELECT sector, round(avg((prediction = target)::DOUBLE), 8) AS accuracy,
       round(avg(target::DOUBLE), 8) AS baseline, count(*) AS rows
FROM preds GROUP BY sector""")
def q_sector_accuracy(spark, sf):
    return rnd(E.sector_accuracy(preds_frame(spark, sf)), {"accuracy": 8, "baseline": 8})


# --------------------------------------------------------------------------- dimensions, profile
from pricelens.operators import registry as G  # noqa: E402
from pricelens.operators import report as P  # noqa: E402
from pricelens.operators.resolve import resolve  # noqa: E402
from pricelens.operators.signals import cap_bucket  # noqa: E402


RESOLVE_STAGES = """,
q AS (SELECT query_id, query, lower(trim(query)) AS q FROM aq),
sfx(sp, suffix) AS (VALUES (0, ' inc.'), (1, ' inc'), (2, ' corp.'), (3, ' corp'), (4, ' corporation'),
   (5, ' co.'), (6, ' co'), (7, ' ltd.'), (8, ' ltd'), (9, ' plc'), (10, ' company'),
   (11, ' holdings'), (12, ' group'), (13, ' ag')),
d AS (SELECT q.query_id, a.ticker AS t1 FROM q JOIN aliases a ON a.alias = q.q),
s AS (SELECT q.query_id, arg_min(a.ticker, sfx.sp) AS t2
      FROM q JOIN sfx ON ends_with(q.q, sfx.suffix)
      JOIN aliases a ON a.alias = trim(left(q.q, length(q.q) - length(sfx.suffix)))
      GROUP BY q.query_id),
recent AS (SELECT DISTINCT ticker FROM bars WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 5 DAY),
l AS (SELECT q.query_id, upper(trim(q.query)) AS t3 FROM q
      WHERE regexp_matches(regexp_replace(upper(trim(q.query)), '[-.]', '', 'g'), '^\\pL+$')
        AND length(upper(trim(q.query))) BETWEEN 1 AND 6
        AND upper(trim(q.query)) IN (SELECT ticker FROM recent))"""


@register("resolve_alias", S.with_(S.BARS, S.ALIASES, S.ALIAS_QUERIES) + RESOLVE_STAGES + """
SELECT q.query_id, q.query, coalesce(t1, t2, t3) AS ticker,
       CASE WHEN t1 IS NOT NULL THEN 'alias' WHEN t2 IS NOT NULL THEN 'suffix'
            WHEN t3 IS NOT NULL THEN 'literal' END AS stage
FROM q LEFT JOIN d USING (query_id) LEFT JOIN s USING (query_id) LEFT JOIN l USING (query_id)""")
def q_resolve_alias(spark, sf):
    return resolve(D.alias_queries(spark, sf), D.aliases(spark, sf), D.bars(spark, sf))


@register("resolve_search", S.with_(S.BARS, S.ALIASES, S.SEARCH_QUERIES, S.QUOTES) + RESOLVE_STAGES + """,
hits AS (SELECT q.query_id, t.symbol, t.kind,
                least(CASE WHEN starts_with(lower(trim(t.name)), q.q) THEN length(trim(t.name)) END,
                      CASE WHEN starts_with(lower(t.symbol), q.q) THEN length(t.symbol) END)
                - length(q.q) AS score
         FROM q JOIN quotes t ON length(q.q) > 0
          AND (starts_with(lower(trim(t.name)), q.q) OR starts_with(lower(t.symbol), q.q))),
top3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, symbol) AS rk FROM hits),
g AS (SELECT query_id, upper(arg_min(symbol, rk)) AS t4 FROM top3
      WHERE rk <= 3 AND kind IN ('EQUITY', 'ETF') GROUP BY query_id)
SELECT q.query_id, q.query, coalesce(t1, t2, t3, t4) AS ticker,
       CASE WHEN t1 IS NOT NULL THEN 'alias' WHEN t2 IS NOT NULL THEN 'suffix'
            WHEN t3 IS NOT NULL THEN 'literal' WHEN t4 IS NOT NULL THEN 'search' END AS stage
FROM q LEFT JOIN d USING (query_id) LEFT JOIN s USING (query_id) LEFT JOIN l USING (query_id)
       LEFT JOIN g USING (query_id)""")
def q_resolve_search(spark, sf):
    """The full resolver with the search stage over the quote table (T7, P20)."""
    return resolve(D.search_queries(spark, sf), D.aliases(spark, sf), D.bars(spark, sf),
                   quotes=D.quotes(spark, sf))


@register("profile_parse", """
SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k,
       coalesce(TRY_CAST(json_extract_string(props, '$.trailingPE') AS DOUBLE), 0.0) AS trailing_pe,
       coalesce(json_extract_string(props, '$.longName'), '') AS long_name
FROM events""")
def q_profile_parse(spark, sf):
    pj = D.profile_json(spark, sf)
    schema = "k BIGINT, trailingPE DOUBLE, longName STRING"
    p = pj.withColumn("p", F.from_json("props", schema))
    return p.select("event_id", "event_type", C("p.k").alias("k"),
                    F.coalesce(C("p.trailingPE"), F.lit(0.0)).alias("trailing_pe"),
                    F.coalesce(C("p.longName"), F.lit("")).alias("long_name"))


PROFILE_ROUND = {"market_cap": 2, "pe_ratio": 8, "revenue_growth": 8, "profit_margin": 8}


@register("profile_defaults", S.with_(S.PROFILE) + """
SELECT ticker, round(coalesce(market_cap, 0), 2) AS market_cap, round(coalesce(trailing_pe, 0), 8) AS pe_ratio,
       round(coalesce(revenue_growth, 0), 8) AS revenue_growth, round(coalesce(profit_margin, 0), 8) AS profit_margin,
       TRY_CAST(trailing_pe AS DOUBLE) IS NOT NULL AS pe_is_number
FROM profile""")
def q_profile_defaults(spark, sf):
    p = D.profile(spark, sf)
    num = lambda c: F.coalesce(C(c).try_cast("double"), F.lit(0.0))
    d = p.select("ticker", num("market_cap").alias("market_cap"), num("trailing_pe").alias("pe_ratio"),
                 num("revenue_growth").alias("revenue_growth"), num("profit_margin").alias("profit_margin"),
                 C("trailing_pe").try_cast("double").isNotNull().alias("pe_is_number"))
    return rnd(d, PROFILE_ROUND)


@register("cap_bucket", S.with_(S.PROFILE) + """
SELECT ticker, round(market_cap, 2) AS market_cap,
       CASE WHEN market_cap > 200e9 THEN 'Large' WHEN market_cap > 10e9 THEN 'Mid' ELSE 'Small' END AS cap_size
FROM profile""")
def q_cap_bucket(spark, sf):
    p = cap_bucket(D.profile(spark, sf))
    return rnd(p.select("ticker", "market_cap", "cap_size"), {"market_cap": 2})


@register("bars_with_profile", S.with_(S.BARS, S.PROFILE) + """
SELECT b.ticker, b.ts, b.close, round(coalesce(p.trailing_pe, 0), 8) AS pe_ratio,
       round(coalesce(p.revenue_growth, 0), 8) AS revenue_growth,
       round(coalesce(p.profit_margin, 0), 8) AS profit_margin,
       CASE WHEN p.market_cap > 200e9 THEN 'Large' WHEN p.market_cap > 10e9 THEN 'Mid' ELSE 'Small' END AS cap_size
FROM bars b LEFT JOIN profile p ON b.ticker = p.ticker""")
def q_bars_with_profile(spark, sf):
    p = cap_bucket(D.profile(spark, sf)).select(
        "ticker", F.coalesce("trailing_pe", F.lit(0.0)).alias("pe_ratio"),
        F.coalesce("revenue_growth", F.lit(0.0)).alias("revenue_growth"),
        F.coalesce("profit_margin", F.lit(0.0)).alias("profit_margin"), "cap_size")
    b = D.bars(spark, sf).select("ticker", "ts", "close").join(p, "ticker", "left")
    b = b.withColumn("cap_size", F.coalesce("cap_size", F.lit("Small")))
    for c in ("pe_ratio", "revenue_growth", "profit_margin"):
        b = b.withColumn(c, F.coalesce(C(c), F.lit(0.0)))
    return rnd(b, {"pe_ratio": 8, "revenue_growth": 8, "profit_margin": 8})


@register("profile_format", S.with_(S.PROFILE) + """
SELECT ticker, printf('$%.1fB', coalesce(market_cap, 0) / 1e9) AS market_cap_text,
  CASE WHEN trailing_pe IS NULL THEN 'N/A' ELSE printf('%.2f', trailing_pe) END AS pe_text,
  CASE WHEN revenue_growth IS NULL THEN 'N/A' ELSE printf('%.1f%%', revenue_growth * 100) END AS growth_text,
  CASE WHEN profit_margin IS NULL THEN 'N/A' ELSE printf('%.1f%%', profit_margin * 100) END AS margin_text
FROM profile""")
def q_profile_format(spark, sf):
    return P.profile_format(D.profile(spark, sf))


# --------------------------------------------------------------------------- news, log, text
@register("news_flatten", S.with_(S.NEWS) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY position) AS rank FROM news)
SELECT ticker, position, title, publisher, summary, '' AS date, '' AS link, rank FROM r WHERE rank <= 10""")
def q_news_flatten(spark, sf):
    return P.news_flatten(D.news_nested(spark, sf), 10)


@register("news_digest", S.with_(S.NEWS) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY position) AS rank FROM news)
SELECT ticker, string_agg('- [' || publisher || '] ' || title || ': ' || left(summary, 160), chr(10) ORDER BY position) AS digest
FROM r WHERE rank <= 6 AND length(title) > 0 GROUP BY ticker""")
def q_news_digest(spark, sf):
    return P.news_digest(P.news_flatten(D.news_nested(spark, sf), 10), 6, 160)


@register("log_retention", S.with_(S.RUN_LOG) + """
SELECT period, retrained_at, total_rows, round(accuracy, 8) AS accuracy,
       round(baseline_always_up_acc, 8) AS baseline_always_up_acc
FROM run_log ORDER BY retrained_at DESC, period DESC LIMIT 50""")
def q_log_retention(spark, sf):
    return rnd(G.log_retention(D.run_log(spark, sf), 50),
               {"accuracy": 8, "baseline_always_up_acc": 8})


@register("log_latest", S.with_(S.RUN_LOG) + """
SELECT arg_max(retrained_at, (retrained_at, period)) AS retrained_at,
       round(arg_max(accuracy, (retrained_at, period)), 8) AS accuracy, 'log' AS source
FROM run_log""")
def q_log_latest(spark, sf):
    return rnd(G.latest_entry(D.run_log(spark, sf)), {"accuracy": 8})


@register("log_fallback", S.with_(S.RUN_LOG) + """,
m AS (SELECT max(ts) AS t FROM events),
l AS (SELECT retrained_at, accuracy FROM run_log ORDER BY retrained_at DESC, period DESC LIMIT 1)
SELECT 'log' AS given, retrained_at, round(accuracy, 8) AS accuracy, 'log' AS source FROM l
UNION ALL SELECT 'empty log', t, NULL, 'mtime' FROM m
UNION ALL SELECT 'no log', t, NULL, 'mtime' FROM m
UNION ALL SELECT 'nothing', NULL, NULL, 'missing'""")
def q_log_fallback(spark, sf):
    """Each link of the chain: a log, an empty one beside a model file, a model file, neither."""
    log = D.run_log(spark, sf)
    mtime = D.event_ticks(spark, sf).agg(F.max("ts").cast("timestamp_ntz").alias("mtime"))
    cases = [("log", log, mtime), ("empty log", log.where("period is null"), mtime), ("no log", None, mtime),
             ("nothing", log.where("period is null"), None)]
    out = None
    for given, lg, mt in cases:
        one = G.latest_info(lg, mt).select(F.lit(given).alias("given"), "*")
        out = one if out is None else out.unionByName(one)
    return rnd(out, {"accuracy": 8})


@register("log_staleness", S.with_(S.RUN_LOG) + """
SELECT period, retrained_at,
       floor((epoch((SELECT max(retrained_at) FROM run_log)) - epoch(retrained_at)) / 86400)::BIGINT AS age_days,
       CASE WHEN floor((epoch((SELECT max(retrained_at) FROM run_log)) - epoch(retrained_at)) / 86400) < 14 THEN 'fresh'
            WHEN floor((epoch((SELECT max(retrained_at) FROM run_log)) - epoch(retrained_at)) / 86400) < 60 THEN 'ageing'
            ELSE 'stale' END AS staleness
FROM run_log""")
def q_log_staleness(spark, sf):
    log = D.run_log(spark, sf)
    now = log.select(F.max("retrained_at")).scalar()
    return G.log_staleness(log, now).select("period", "retrained_at", C("age_days").cast("long"),
                                            "staleness")


@register("age_text", """
WITH a AS (SELECT event_id,
  ((epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) // 1000000)::BIGINT AS s FROM events),
b AS (SELECT event_id, s, s // 60 AS mi, s // 3600 AS h, s // 86400 AS d FROM a)
SELECT event_id, CASE
  WHEN s < 60 THEN 'just now'
  WHEN mi < 60 THEN mi || ' min ago'
  WHEN h < 24 THEN h || ' hr ago'
  WHEN d < 7 THEN d || ' day' || CASE WHEN d != 1 THEN 's' ELSE '' END || ' ago'
  WHEN d // 7 < 5 THEN (d // 7) || ' week' || CASE WHEN d // 7 != 1 THEN 's' ELSE '' END || ' ago'
  WHEN d // 30 < 12 THEN (d // 30) || ' month' || CASE WHEN d // 30 != 1 THEN 's' ELSE '' END || ' ago'
  ELSE (d // 365) || ' year' || CASE WHEN d // 365 != 1 THEN 's' ELSE '' END || ' ago' END AS age
FROM b""")
def q_age_text(spark, sf):
    from pricelens.functions.scalar import age_text
    ev = D.profile_json(spark, sf).select("event_id")
    ev = D.event_ticks(spark, sf).select("event_id", "ts")
    now = ev.select(F.max("ts")).scalar()
    return ev.select("event_id", age_text(C("ts"), now).alias("age"))


@register("returns_text", PERIOD_RETURNS_SQL + """
SELECT ticker, string_agg(horizon || ': ' || printf('%+.1f%%', ret_pct), ' | ' ORDER BY horizon_order) AS returns_text
FROM rets GROUP BY ticker""")
def q_returns_text(spark, sf):
    return P.returns_text(M.period_returns(D.bars(spark, sf)))


@register("report_lines", f"""
WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                  unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
s AS (SELECT doc_id, line_no, regexp_replace(raw, '^{S.WS}+|{S.WS}+$', '', 'g') AS s FROM e)
SELECT doc_id, line_no::INTEGER AS line_no,
       CASE WHEN starts_with(s, '### ') THEN 'heading' WHEN starts_with(s, '- ') THEN 'bullet' ELSE 'paragraph' END AS kind,
       CASE WHEN starts_with(s, '### ') THEN substr(s, 5) WHEN starts_with(s, '- ') THEN substr(s, 3) ELSE s END AS content
FROM s WHERE length(s) > 0""")
def q_report_lines(spark, sf):
    return P.report_lines(D.reports(spark, sf))


# --------------------------------------------------------------------------- sets, joins
@register("union_sources", S.with_(S.BARS) + """,
sec AS (SELECT r_name AS ticker, l_shipdate AS ts, arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS close
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, l_shipdate)
SELECT ticker, ts, close, sector FROM bars
UNION ALL SELECT ticker, ts, close, NULL AS sector FROM sec""")
def q_union_sources(spark, sf):
    a = D.bars(spark, sf).select("ticker", "ts", "close", "sector")
    b = D.bars_sector(spark, sf).select("ticker", "ts", "close")
    return a.unionByName(b, allowMissingColumns=True)


@register("loaded_tickers", S.with_(S.BARS) + """,
loaded AS (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) >= 1000)
SELECT r_name AS sector, n_name AS ticker FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE n_name IN (SELECT ticker FROM loaded)""")
def q_loaded_tickers(spark, sf):
    loaded = D.bars(spark, sf).groupBy("ticker").count().where(C("count") >= 1000)
    return D.universe(spark, sf).join(loaded, "ticker", "left_semi").select("sector", "ticker")


@register("skipped_tickers", S.with_(S.BARS) + """,
loaded AS (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) >= 1000)
SELECT r_name AS sector, n_name AS ticker FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE n_name NOT IN (SELECT ticker FROM loaded)""")
def q_skipped_tickers(spark, sf):
    loaded = D.bars(spark, sf).groupBy("ticker").count().where(C("count") >= 1000)
    return D.universe(spark, sf).join(loaded, "ticker", "left_anti").select("sector", "ticker")


@register("rows_map", S.with_(S.BARS) + """
SELECT sector, count(*) AS tickers, string_agg(ticker || '=' || n, ',' ORDER BY ticker) AS rows_per_ticker
FROM (SELECT sector, ticker, count(*) AS n FROM bars GROUP BY ALL) GROUP BY sector""")
def q_rows_map(spark, sf):
    """Per sector map ticker -> rows (at most the sector's tickers per map), shown as text."""
    g = D.bars(spark, sf).groupBy("sector", "ticker").agg(F.count("*").alias("n"))
    m = g.groupBy("sector").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ticker", "n")))).alias("m"))
    shown = F.transform(F.map_keys("m"), lambda t: F.concat(t, F.lit("="), F.element_at(C("m"), t).cast("string")))
    return m.select("sector", F.size("m").cast("long").alias("tickers"), F.array_join(shown, ",").alias("rows_per_ticker"))


@register("ticker_lists", S.with_(S.BARS) + """,
loaded AS (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) >= 1000)
SELECT CASE WHEN l.ticker IS NULL THEN 'skipped' ELSE 'used' END AS status, string_agg(n_name, ',' ORDER BY n_name) AS tickers
FROM nation LEFT JOIN loaded l ON l.ticker = n_name GROUP BY status""")
def q_ticker_lists(spark, sf):
    """Used / skipped ticker lists of the universe (one list per status, shown as text)."""
    loaded = D.bars(spark, sf).groupBy("ticker").count().where(C("count") >= 1000)
    u = D.universe(spark, sf).join(loaded.select("ticker", F.lit("used").alias("status")), "ticker", "left")
    u = u.withColumn("status", F.coalesce("status", F.lit("skipped")))
    return u.groupBy("status").agg(F.array_join(F.sort_array(F.collect_list("ticker")), ",").alias("tickers"))


# --------------------------------------------------------------------------- model
from pricelens.operators import boost as B  # noqa: E402
from pricelens.operators import training as T  # noqa: E402
from pricelens.functions.scalar import sanitize  # noqa: E402
from pricelens.schema import FEATURES_7, FEATURES_10  # noqa: E402

MODEL_ROUNDS = 100  # the reference: 100 stages, depth 3, learning rate 0.1


_saved: dict[tuple, str] = {}


def fitted_model(spark, sf, rounds: int = MODEL_ROUNDS, bars: DataFrame | None = None) -> B.SammeModel:
    """Model trained on the embargo split's train part. Within one application it is fitted and saved once for each
    set of tables; later queries load it, as a service does that scores with a saved model. ``bars``: those of the
    tables, where the caller has them already."""
    key = (spark.sparkContext.applicationId, str(sf), rounds)
    if key not in _saved:
        path = B.model_path(spark)
        B.fit_samme(split_frame(spark, sf, bars).where(C("part") == "train"), FEATURES_7, rounds=rounds).save(spark, path)
        _saved[key] = path
    return B.SammeModel.load(spark, _saved[key])


@register("boost_fit")
def q_boost_fit(spark, sf):
    """Stages of the fitted ensemble: stage number and weight."""
    m = fitted_model(spark, sf)
    return spark.createDataFrame([(i + 1, a) for i, a in enumerate(m.alphas)],
                                 "stage int, alpha double")


@register("boost_importance")
def q_boost_importance(spark, sf):
    return T.importance_table(spark, fitted_model(spark, sf))


@register("model_roundtrip", S.with_(S.BARS, *S.TRAINING, recursive=True) + """
SELECT ticker, ts, true AS same FROM parts WHERE part = 'test'""")
def q_model_roundtrip(spark, sf):
    """Save, reload and score the test rows; both models must agree row by row."""
    bars = kept_bars(spark, sf)
    m = fitted_model(spark, sf, bars=bars)
    path = B.model_path(spark)
    m.save(spark, path)
    m2 = B.SammeModel.load(spark, path)
    test = split_frame(spark, sf, bars).where(C("part") == "test").checkpoint(eager=True)  # both models score the same rows
    a = m.transform(test).select("ticker", "ts", C("decision").alias("d1"))
    b = m2.transform(test).select("ticker", "ts", C("decision").alias("d2"))
    return a.join(b, ["ticker", "ts"]).select("ticker", "ts", (C("d1") == C("d2")).alias("same"))


def latest_features(spark, sf, bars: DataFrame | None = None) -> DataFrame:
    """Newest bar of each ticker with the 10 feature values, sanitised for scoring."""
    d = _latest(I.indicators_core(L.min_history(prepare(D.bars(spark, sf) if bars is None else bars))))
    p = D.profile(spark, sf).select("ticker", C("trailing_pe").alias("pe_ratio"),
                                    "revenue_growth", "profit_margin")
    d = d.join(p, "ticker", "left")
    return d.select("ticker", "sector", "ts", "close", *[sanitize(c).alias(c) for c in FEATURES_10])


@register("score_latest")
def q_score_latest(spark, sf):
    from pricelens.operators.signals import confidence_text
    s = fitted_model(spark, sf).transform(latest_features(spark, sf))
    return s.select("ticker", "ts", "close", "prediction", "direction",
                    F.round("confidence", 4).alias("confidence"),
                    confidence_text(C("confidence")).alias("confidence_text"))


SAN_ROUND = {**FEATURE_ROUND, "pe_ratio": 8, "revenue_growth": 8, "profit_margin": 8}


def _san_sql(c):
    return f"round(CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0.0 ELSE {c} END, {SAN_ROUND[c]}) AS {c}"


@register("sanitize_features", S.with_(S.BARS, *S.INDICATORS, S.PROFILE, recursive=True) + f""",
x AS (SELECT i.*, p.trailing_pe AS pe_ratio, p.revenue_growth, p.profit_margin
      FROM ind i LEFT JOIN profile p ON i.ticker = p.ticker)
SELECT ticker, ts, {", ".join(_san_sql(c) for c in FEATURES_10)} FROM x""")
def q_sanitize_features(spark, sf):
    d = I.indicators_core(D.bars(spark, sf))
    p = D.profile(spark, sf).select("ticker", C("trailing_pe").alias("pe_ratio"),
                                    "revenue_growth", "profit_margin")
    d = d.join(p, "ticker", "left")
    return rnd(d.select("ticker", "ts", *[sanitize(c).alias(c) for c in FEATURES_10]), SAN_ROUND)


def data_importances(spark, sf) -> DataFrame:
    """Importances derived from the data: |corr(feature, target)| normalised to 1,
    ranked (one row per feature)."""
    u = L.usable_rows(training_frame(spark, sf))
    corr = u.select(*[F.abs(F.corr(c, C("target").cast("double"))).alias(c) for c in FEATURES_7])
    tot = sum((C(c) for c in FEATURES_7), F.lit(0.0))
    e = corr.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
                                                 (C(c) / tot).alias("importance"))
                                        for c in FEATURES_7])).alias("e")).select("e.*")
    return e.withColumn("rank", F.row_number().over(
        Window.orderBy(C("importance").desc(), C("feature"))))


@register("importance_rank", TRAIN_SQL + """,
c AS (SELECT abs(corr(rsi, target)) AS rsi, abs(corr(macd, target)) AS macd,
             abs(corr(macd_hist, target)) AS macd_hist, abs(corr(bb_position, target)) AS bb_position,
             abs(corr(volume_ratio, target)) AS volume_ratio, abs(corr(volatility, target)) AS volatility,
             abs(corr(daily_return, target)) AS daily_return FROM usable),
l AS (UNPIVOT c ON rsi, macd, macd_hist, bb_position, volume_ratio, volatility, daily_return
      INTO NAME feature VALUE v),
n AS (SELECT feature, v / sum(v) OVER () AS importance FROM l)
SELECT feature, round(importance, 8) AS importance,
       row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM n""")
def q_importance_rank(spark, sf):
    return rnd(data_importances(spark, sf), {"importance": 8})


@register("importance_text")
def q_importance_text(spark, sf):
    bars = kept_bars(spark, sf)
    lf = latest_features(spark, sf, bars).select("ticker", *FEATURES_7)
    return P.importance_lines(lf, T.importance_table(spark, fitted_model(spark, sf, bars=bars)))


@register("train_run")
def q_train_run(spark, sf):
    bars = L.min_history(restrict_period(D.bars(spark, sf), 10))  # the period first: what is left must be long enough
    split = L.embargo_split(L.usable_rows(I.add_label(I.indicators_core(prepare(bars)), 30)))
    rpt = bars.groupBy("ticker").agg(F.count("*").alias("n_rows"))
    model, rec = T.train_run(split, D.universe(spark, sf), rpt, rounds=MODEL_ROUNDS)
    return rec


@register("briefing_text")
def q_briefing_text(spark, sf):
    return briefings(spark, sf, kept_bars(spark, sf))


def briefings(spark, sf, bars: DataFrame) -> DataFrame:
    """The briefing of every instrument. One stored bar frame and one stored latest-feature frame feed every part."""
    model = fitted_model(spark, sf, bars=bars)
    latest = latest_features(spark, sf, bars).checkpoint(eager=True)
    board = signal_board(bars)
    scored = model.transform(latest).select("ticker", "direction", "confidence")
    risk = M.risk_metrics(bars)
    rt = P.returns_text(M.period_returns(bars))
    lf = latest.select("ticker", *FEATURES_7)
    it = P.importance_lines(lf, T.importance_table(spark, model))
    fund = P.profile_format(D.profile(spark, sf))
    # news items are keyed by conversation id; the instrument with that nation key owns them
    nk = D.read_table(spark, sf, "nation", "n_nationkey", "n_name")
    dg = P.news_digest(P.news_flatten(D.news_nested(spark, sf), 10), 6, 160)
    dg = dg.join(nk, dg.ticker == nk.n_nationkey).select(C("n_name").alias("ticker"), "digest")
    return P.briefing_text(board, scored, risk, rt, it, fund, dg)


@register("analyse_queries")
def q_analyse_queries(spark, sf):
    """The interactive flow for a whole table of user search strings: resolve each to an
    instrument, then attach that instrument's briefing (signals, model call, returns,
    risk, importances, fundamentals, news). Unresolved queries keep a null briefing."""
    bars = kept_bars(spark, sf)
    r = resolve(D.alias_queries(spark, sf), D.aliases(spark, sf), bars, quotes=D.quotes(spark, sf))
    b = briefings(spark, sf, bars)
    return r.join(b, "ticker", "left").select("query_id", "query", "ticker", "stage",
                                              *[c for c in b.columns if c != "ticker"])


@register("fundamentals_text", S.with_(S.PROFILE) + """
SELECT ticker, concat_ws(chr(10),
  'P/E (trailing): ' || coalesce(printf('%.2f', trailing_pe), 'N/A'),
  'P/E (forward): N/A', 'PEG ratio: N/A', 'Price/Book: N/A', 'Price/Sales: N/A',
  'Revenue Growth: ' || coalesce(printf('%.2f', revenue_growth), 'N/A'),
  'Earnings Growth: N/A',
  'Profit Margin: ' || coalesce(printf('%.2f', profit_margin), 'N/A'),
  'Operating Margin: N/A', 'ROE: N/A', 'ROA: N/A', 'Debt/Equity: N/A', 'Current Ratio: N/A',
  'Dividend Yield: N/A', 'Payout Ratio: N/A', 'Beta: N/A', 'Analyst Target: N/A',
  'Analyst Rating: N/A') AS fundamentals
FROM profile""")
def q_fundamentals_text(spark, sf):
    return P.fundamentals_block(D.profile(spark, sf))


_DATE_VARIANTS_SQL = """
  CASE event_id % 4
    WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
    WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
    WHEN 2 THEN 'n/a-' || event_type || '-' || CAST(event_id AS VARCHAR)
    ELSE strftime(ts, '%Y-%m-%d') END"""


def date_variants(spark, sf) -> DataFrame:
    """Publication-date strings in the shapes a provider sends (UTC 'Z', an offset,
    date only, junk), made from the events table."""
    ev = D.event_ticks(spark, sf)
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    m = F.pmod(C("event_id"), F.lit(4))
    raw = (F.when(m == 0, F.concat(base, F.lit("Z")))
           .when(m == 1, F.concat(base, F.lit("+02:00")))
           .when(m == 2, F.concat(F.lit("n/a-"), C("event_type"), F.lit("-"), C("event_id").cast("string")))
           .otherwise(F.date_format("ts", "yyyy-MM-dd")))
    return ev.select("event_id", raw.alias("raw"))


@register("news_dates", f"""
WITH v AS (SELECT event_id, {_DATE_VARIANTS_SQL} AS raw FROM events),
p AS (SELECT event_id, raw,
        coalesce(try_strptime(raw, '%Y-%m-%dT%H:%M:%SZ'),
                 try_strptime(left(raw, 19), '%Y-%m-%dT%H:%M:%S'),
                 try_strptime(raw, '%Y-%m-%d')) AS t FROM v)
SELECT event_id, raw, CASE WHEN raw = '' THEN '' WHEN t IS NOT NULL THEN strftime(t, '%b %d, %Y')
                          ELSE left(raw, 10) END AS date_text FROM p""")
def q_news_dates(spark, sf):
    from pricelens.functions.scalar import news_date
    return date_variants(spark, sf).select("event_id", "raw", news_date(C("raw")).alias("date_text"))


@register("news_cards", S.with_(S.NEWS) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY position) AS rank FROM news)
SELECT ticker, position, title,
       CASE WHEN length(summary) > 280 THEN left(summary, 280) || '...' ELSE summary END AS summary_short,
       '' AS date_text
FROM r WHERE rank <= 10""")
def q_news_cards(spark, sf):
    return P.news_cards(P.news_flatten(D.news_nested(spark, sf), 10), 280)


# --------------------------------------------------------------------------- across instruments and dates
from pricelens.operators import cross as X  # noqa: E402


@register("asof_profile", S.with_(S.BARS, S.FUNDAMENTALS) + """
SELECT b.ticker, b.ts, b.close, f.as_of, round(f.revenue, 2) AS revenue, f.n_orders,
       date_diff('day', f.as_of::DATE, b.ts::DATE) AS age_days
FROM bars b ASOF LEFT JOIN fundamentals f ON b.ticker = f.ticker AND b.ts >= f.as_of""")
def q_asof_profile(spark, sf):
    """Bars with the newest figures that were out on the day."""
    d = X.asof_join(D.bars(spark, sf).select("ticker", "ts", "close"), D.fundamentals(spark, sf), ["revenue", "n_orders"])
    return rnd(d, {"revenue": 2}).withColumn("age_days", F.date_diff(C("ts").cast("date"), C("as_of").cast("date")).cast("long"))


@register("walk_forward_folds", S.with_(S.BARS, *S.TRAINING[:-1], recursive=True) + """,
rows AS (SELECT ticker, ts, target, (macd_hist > 0)::INTEGER AS prediction,
                lead(ts, 30) OVER (PARTITION BY ticker ORDER BY ts) AS label_end FROM usable),
dates AS (SELECT ts, least(((row_number() OVER (ORDER BY ts) - 1) * 6) // count(*) OVER (), 5) AS fold FROM (SELECT DISTINCT ts FROM usable)),
folds AS (SELECT fold, min(ts) AS start, max(ts) AS stop FROM dates WHERE fold > 0 GROUP BY fold),
parts AS (SELECT f.fold, r.*, CASE WHEN r.ts >= f.start THEN 'test' WHEN r.label_end < f.start THEN 'train' ELSE 'purged' END AS part
          FROM rows r JOIN folds f ON r.ts <= f.stop),
g AS (SELECT fold, count_if(part = 'train') AS train_rows, count_if(part = 'purged') AS purged_rows, count_if(part = 'test') AS test_rows,
             avg(target) FILTER (part = 'train') AS train_up, avg(target) FILTER (part = 'test') AS test_up,
             avg((prediction = target)::INTEGER) FILTER (part = 'test') AS accuracy FROM parts GROUP BY fold)
SELECT fold::INTEGER AS fold, train_rows, purged_rows, test_rows, round(train_up, 8) AS train_up, round(test_up, 8) AS test_up,
       round(accuracy, 8) AS accuracy, round(CASE WHEN train_up > 0.5 THEN test_up WHEN train_up IS NOT NULL THEN 1 - test_up END, 8) AS majority_acc FROM g""")
def q_walk_forward_folds(spark, sf):
    """Expanding folds by date; labels that reach into a test part are purged from its training part."""
    u = L.usable_rows(training_frame(spark, sf)).select("ticker", "ts", "target", (C("macd_hist") > 0).cast("int").alias("prediction"))
    return rnd(X.fold_metrics(X.walk_forward(u, 5, 30)), {c: 8 for c in ("train_up", "test_up", "accuracy", "majority_acc")})


MOMENTUM_SQL = S.with_(S.BARS) + """,
m AS (SELECT ticker, sector, ts, close / lag(close, 20) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS momentum FROM bars)"""


def momentum(spark, sf) -> DataFrame:
    d = prepare(D.bars(spark, sf))
    return d.select("ticker", "sector", "ts", (C("close") / F.lag("close", 20).over(series_window()) - 1).alias("momentum"))


@register("sector_momentum", MOMENTUM_SQL + """,
g AS (SELECT *, sum(momentum) OVER w AS s, count(momentum) OVER w AS n FROM m WINDOW w AS (PARTITION BY sector, ts))
SELECT ticker, sector, ts, round(momentum, 8) AS momentum,
       round(CASE WHEN n > 1 AND momentum IS NOT NULL THEN (s - momentum) / (n - 1) END, 8) AS peers,
       round(CASE WHEN n > 1 THEN momentum - (s - momentum) / (n - 1) END, 8) AS relative FROM g""")
def q_sector_momentum(spark, sf):
    """20-bar momentum against the mean of the sector's other instruments on the day."""
    return rnd(X.sector_relative(momentum(spark, sf), "momentum"), {"momentum": 8, "peers": 8, "relative": 8})


@register("cross_rank", MOMENTUM_SQL + """,
r AS (SELECT ticker, ts, round(momentum, 4) + 0.0 AS momentum FROM m)
SELECT ticker, ts, momentum, CASE WHEN momentum IS NOT NULL THEN (rank() OVER w)::DOUBLE END AS rank,
       CASE WHEN momentum IS NOT NULL THEN (count(*) OVER (PARTITION BY ts, momentum IS NULL))::DOUBLE END AS n,
       round(CASE WHEN momentum IS NOT NULL THEN percent_rank() OVER w END, 8) AS pct_rank
FROM r WINDOW w AS (PARTITION BY ts, momentum IS NULL ORDER BY momentum)""")
def q_cross_rank(spark, sf):
    """Rank of every instrument's momentum among all instruments of the day (ties by four decimals)."""
    d = momentum(spark, sf).select("ticker", "ts", (F.round("momentum", 4) + 0.0).alias("momentum"))
    d = X.cross_rank(d, "momentum")
    return rnd(d.withColumns({c: C(c).cast("double") for c in ("rank", "n")}), {"pct_rank": 8})


from pricelens.plans import more, texts  # noqa: E402,F401  (register further queries)
