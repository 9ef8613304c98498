"""Registered queries of what is shown: bands of every kind, whole profiles, news at every level, previews and briefings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.operators import report as P
from pricelens.operators import signals as G
from pricelens.operators import summary as M
from pricelens.plans import more
from pricelens.plans import sql as S
from pricelens.plans.catalog import ORACLE, RISK_COLS, q_returns_text, q_risk_metrics, register
from pricelens.sources import derived as D
from pricelens.sources.profile import parse_profiles

C = F.col


def _state(expr: str, missing: int) -> str:
    return f"CASE WHEN o_orderkey % {missing} > 0 THEN {expr} END"


STATES = f"""states AS (SELECT o_orderkey AS state_id, {_state('(o_orderkey * 7 % 1001)::DOUBLE / 10', 11)} AS rsi, {_state('(o_orderkey % 5 - 2)::DOUBLE', 13)} AS macd,
  {_state('(o_orderkey * 3 % 131 - 15)::DOUBLE / 100', 17)} AS bb_position, {_state('(o_orderkey % 23)::DOUBLE / 10', 19)} AS volume_ratio,
  {_state('(o_orderkey * 3 % 7)::DOUBLE', 23)} AS sma_50, {_state('(o_orderkey * 5 % 9)::DOUBLE', 29)} AS sma_200, {_state('(o_orderkey * 13 % 101)::DOUBLE', 31)} AS stoch_k,
  {_state('(o_orderkey * 5 % 41 - 15)::DOUBLE / 10', 37)} AS sharpe, {_state('(o_orderkey * 11 % 97)::DOUBLE / 2', 41)} AS annual_volatility,
  {_state('(o_orderkey * 3 % 113 - 112)::DOUBLE / 2', 43)} AS max_drawdown, {_state('(o_orderkey * 7 % 41 + 90)::DOUBLE / 2', 47)} AS confidence,
  (o_orderkey % 90)::DOUBLE AS age_days, {_state('(o_orderkey * 17 % 301)::DOUBLE * 1e9', 53)} AS market_cap FROM orders)"""


def _three(c: str, high: float, low: float, above: str, below: str, between: str) -> str:
    return f"CASE WHEN {c} > {high} THEN '{above}' WHEN {c} < {low} THEN '{below}' ELSE '{between}' END"


@register("board_bands", S.with_(STATES) + f"""
SELECT state_id, {_three('rsi', 70, 30, 'OVERBOUGHT', 'OVERSOLD', 'NEUTRAL')} AS rsi_band, CASE WHEN macd > 0 THEN 'BULLISH' ELSE 'BEARISH' END AS macd_band,
  {_three('bb_position', '0.8::DOUBLE', '0.2::DOUBLE', 'UPPER BAND', 'LOWER BAND', 'MID RANGE')} AS bb_band,
  {_three('volume_ratio', '1.5::DOUBLE', '0.7::DOUBLE', 'HIGH VOLUME', 'LOW VOLUME', 'NORMAL')} AS volume_band,
  CASE WHEN sma_50 > sma_200 THEN 'GOLDEN CROSS' ELSE 'DEATH CROSS' END AS trend, {_three('stoch_k', 80, 20, 'OVERBOUGHT', 'OVERSOLD', 'NEUTRAL')} AS stoch_band,
  CASE WHEN sharpe > 1 THEN 'GOOD' WHEN sharpe > 0 THEN 'FAIR' ELSE 'POOR' END AS sharpe_band,
  CASE WHEN annual_volatility > 35 THEN 'HIGH' WHEN annual_volatility > 22 THEN 'ELEVATED' ELSE 'LOW' END AS vol_band,
  CASE WHEN max_drawdown < -40 THEN 'SEVERE' WHEN max_drawdown < -25 THEN 'MODERATE' ELSE 'MILD' END AS dd_band,
  CASE WHEN confidence > 60 THEN 'high' WHEN confidence > 55 THEN 'moderate' ELSE 'low' END AS confidence_text,
  CASE WHEN age_days < 14 THEN 'fresh' WHEN age_days < 60 THEN 'ageing' ELSE 'stale' END AS age_band,
  CASE WHEN market_cap > 200e9 THEN 'Large' WHEN market_cap > 10e9 THEN 'Mid' ELSE 'Small' END AS cap_size FROM states""")
def q_board_bands(spark, sf):
    """Every band of every display, its bounds and missing values included: one projection of the scan."""
    d = G.cap_bucket(G.indicator_bands(D.board_states(spark, sf)))
    d = d.withColumns({"confidence_text": G.confidence_text("confidence"), "age_band": G.staleness("age_days")})
    risk = G.risk_columns()
    return d.withColumns(risk).select("state_id", "rsi_band", "macd_band", "bb_band", "volume_band", "trend", "stoch_band", *risk, "confidence_text", "age_band", "cap_size")


PROFILE_NUMBERS = ["trailingPE", "marketCap", "revenueGrowth", "profitMargins"]
DOCUMENTS = r"""docs AS (SELECT s_name AS ticker, CASE s_suppkey % 31 WHEN 1 THEN '' WHEN 2 THEN '{"longName": "cut' WHEN 3 THEN '[1, 2]' WHEN 4 THEN 'null' WHEN 5 THEN NULL ELSE
  '{' || concat_ws(', ', CASE WHEN s_suppkey % 5 > 0 THEN '"longName": "' || s_name || ' \"Ltd\""' END,
    CASE s_suppkey % 4 WHEN 1 THEN '"sector": "Energy"' WHEN 2 THEN '"sector": null' WHEN 3 THEN '"sector": 7' END,
    CASE WHEN s_suppkey % 3 > 0 THEN '"industry": "Oil & Gas"' END, CASE WHEN s_suppkey % 7 > 2 THEN '"recommendationKey": "buy"' END,
    CASE WHEN s_suppkey % 6 > 0 THEN '"longBusinessSummary": "' || repeat(s_name || ' é ', 40) || '"' END,
    CASE s_suppkey % 6 WHEN 1 THEN '"trailingPE": ' || cents WHEN 2 THEN '"trailingPE": "' || cents || '"' WHEN 3 THEN '"trailingPE": 12.625' WHEN 4 THEN '"trailingPE": null'
      WHEN 5 THEN '"trailingPE": -2.5e-3' END,
    CASE s_suppkey % 4 WHEN 0 THEN '"marketCap": ' || cents || '00000' WHEN 1 THEN '"marketCap": true' WHEN 2 THEN '"marketCap": 0' END,
    CASE s_suppkey % 3 WHEN 0 THEN '"revenueGrowth": 0.125' WHEN 1 THEN '"revenueGrowth": [1]' END, CASE WHEN s_suppkey % 2 = 0 THEN '"profitMargins": -0.5' END) || '}' END AS props
  FROM (SELECT *, round(s_acctbal * 100)::BIGINT::VARCHAR AS cents FROM supplier)),
j AS (SELECT ticker, coalesce(json_valid(props) AND json_type(CASE WHEN json_valid(props) THEN props::JSON END) = 'OBJECT', false) AS valid,
  CASE WHEN json_valid(props) THEN props::JSON END AS p FROM docs)"""
_word = lambda f, d: f"coalesce(CASE WHEN json_type(p, '$.{f}') = 'VARCHAR' THEN json_extract_string(p, '$.{f}') END, {d}) AS {f}"
_number = lambda f: f"CASE WHEN json_type(p, '$.{f}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract_string(p, '$.{f}')::DOUBLE END AS {f}"


@register("profile_documents", S.with_(DOCUMENTS) + f"""
SELECT ticker, valid, {_word('longName', 'NULL')}, {_word('sector', "'Unknown'")}, {_word('industry', "'Unknown'")}, {_word('recommendationKey', "'N/A'")},
  {_word('longBusinessSummary', "''")}, {", ".join(map(_number, PROFILE_NUMBERS))} FROM j""")
def q_profile_documents(spark, sf):
    """Profiles out of JSON whose fields are given, missing, null or of another type."""
    return parse_profiles(D.profile_documents(spark, sf), PROFILE_NUMBERS)


@register("news_levels", S.with_(S.NEWS) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY position) AS rank, (ticker + position) % 8 AS m, position % 5 <> 4 AS there FROM news),
v AS (SELECT ticker, position, rank, CASE WHEN there AND m <> 1 THEN coalesce(title, '') ELSE '' END AS title, CASE WHEN there AND m NOT IN (4, 5) THEN coalesce(publisher, '') ELSE '' END AS publisher,
  CASE WHEN there AND m <> 2 THEN coalesce(summary, '') ELSE '' END AS summary,
  CASE WHEN there AND m <> 3 THEN '2024-0' || (position % 9 + 1) || '-1' || ticker % 10 || 'T08:30:00Z' ELSE '' END AS date,
  CASE WHEN there AND m NOT IN (6, 7) THEN 'https://example.org/' || ticker || '/' || position ELSE '' END AS link FROM r WHERE rank <= 10)
SELECT ticker, position, rank::BIGINT AS rank, title, publisher, summary, date, link, CASE WHEN date = '' THEN '' ELSE strftime(try_strptime(date, '%Y-%m-%dT%H:%M:%SZ'), '%b %d, %Y') END AS date_text,
  CASE WHEN length(summary) > 280 THEN left(summary, 280) || '...' ELSE summary END AS summary_short FROM v""")
def q_news_levels(spark, sf):
    """Flat news with dates and links out of items that lack one level or another, and what their cards show."""
    flat = P.news_flatten(D.news_levels(spark, sf), 10)
    cards = P.news_cards(flat, 280).select("ticker", "position", "summary_short", "date_text")
    return flat.withColumn("rank", C("rank").cast("long")).join(cards, ["ticker", "position"])


@register("bars_preview", S.with_(S.BARS, S.BP) + """
SELECT ticker, sector, ts, open, high, low, close, volume, pos::BIGINT AS pos, 'head' AS part FROM bp WHERE pos < 5
UNION ALL SELECT ticker, sector, ts, open, high, low, close, volume, pos::BIGINT, 'tail' FROM bp WHERE n_rows - 1 - pos < 5""")
def q_bars_preview(spark, sf):
    """The first and the newest five bars of every instrument."""
    d = M.preview(D.bars(spark, sf), 5)
    return d.withColumn("pos", C("pos").cast("long"))


#: How long after its newest entry the query reads the log (fixed value of this query).
LATER = "INTERVAL '9 05:00:00' DAY TO SECOND"


@register("freshness_text", S.with_(S.RUN_LOG) + f""",
e AS (SELECT period, CASE WHEN period <> 'A' OR total_rows % 3 > 0 THEN retrained_at END AS retrained_at, total_rows, CASE WHEN total_rows % 4 > 0 THEN round(accuracy, 6) END AS accuracy FROM run_log),
s AS (SELECT *, date_diff('second', retrained_at, (SELECT max(retrained_at) + INTERVAL '9 days 5 hours' FROM run_log)) AS s FROM e),
d AS (SELECT *, s // 86400 AS d FROM s)
SELECT period, retrained_at, total_rows, accuracy, coalesce(strftime(retrained_at, '%Y-%m-%d'), '—') AS date_text, coalesce(strftime(retrained_at, '%Y-%m-%d %H:%M UTC'), 'unknown') AS time_text,
  CASE WHEN s IS NULL THEN 'unknown' WHEN d < 7 THEN d || CASE WHEN d = 1 THEN ' day ago' ELSE ' days ago' END WHEN d // 7 < 5 THEN d // 7 || CASE WHEN d // 7 = 1 THEN ' week ago' ELSE ' weeks ago' END
    WHEN d // 30 < 12 THEN d // 30 || CASE WHEN d // 30 = 1 THEN ' month ago' ELSE ' months ago' END ELSE d // 365 || CASE WHEN d // 365 = 1 THEN ' year ago' ELSE ' years ago' END END AS age,
  CASE WHEN coalesce(d, 999) < 14 THEN 'fresh' WHEN coalesce(d, 999) < 60 THEN 'ageing' ELSE 'stale' END AS band,
  coalesce(printf('%.1f%% acc', accuracy * 100), 'accuracy n/a') AS short_accuracy, coalesce(printf('%.2f%%', accuracy * 100), 'n/a') AS accuracy_text FROM d""")
def q_freshness_text(spark, sf):
    """What the header says of every entry of the run log, entries without time or accuracy included."""
    log, n = D.run_log(spark, sf), C("total_rows")
    e = log.select("period", F.when((C("period") != "A") | (n % 3 > 0), C("retrained_at")).alias("retrained_at"), "total_rows", F.when(n % 4 > 0, F.round("accuracy", 6)).alias("accuracy"))
    now = log.select((F.max("retrained_at") + F.expr(LATER)).cast("timestamp")).scalar()
    return P.freshness(e, now)


NATION_INFO = more.INFO.replace("info AS", "suppliers AS", 1) + """,
firsts AS (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS company FROM supplier GROUP BY s_nationkey),
info AS (SELECT n_name AS ticker, CASE WHEN n_nationkey % 5 > 0 THEN r_name END AS sector, s.* EXCLUDE (ticker)
  FROM firsts JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN suppliers s ON s.ticker = company)"""


@register("briefing_full", "WITH p AS (" + S.with_(NATION_INFO) + more.profile_sql("coalesce(sector, 'Unknown')") + f"""),
f AS ({ORACLE["fixed_latest"]}), i AS ({ORACLE["fixed_importance_text"]}), r AS ({ORACLE["returns_text"]}), k AS ({ORACLE["risk_metrics"]}), t AS ({ORACLE["trend_text"]}),
n AS (SELECT n_name AS ticker, digest FROM ({ORACLE["news_digest"]}) g JOIN nation ON n_nationkey = g.ticker)
SELECT n_name AS ticker, concat_ws(chr(10), 'TICKER: ' || n_name, coalesce(profile, ''), 'PREDICTION: ' || coalesce(direction, 'N/A'), 'CONFIDENCE: ' || coalesce(printf('%.1f%%', confidence), 'N/A'),
  'INDICATOR IMPORTANCE & VALUES:', coalesce(importance_text, ''), 'HISTORICAL RETURNS:', coalesce(returns_text, ''), 'RISK METRICS:',
  printf('Annualised Return: %.1f%%', coalesce(annual_return, 0)), printf('Annualised Volatility: %.1f%%', coalesce(annual_volatility, 0)), printf('Sharpe Ratio: %.2f', coalesce(sharpe, 0)),
  printf('Sortino Ratio: %.2f', coalesce(sortino, 0)), printf('Max Drawdown: %.1f%%', coalesce(max_drawdown, 0)), printf('Positive Days: %.1f%%', coalesce(positive_days, 0)),
  'TREND SIGNALS:', coalesce(t.trend, ''), 'RECENT NEWS:', coalesce(digest, '')) AS briefing
FROM nation LEFT JOIN p ON p.ticker = n_name LEFT JOIN f ON f.ticker = n_name LEFT JOIN i ON i.ticker = n_name LEFT JOIN r ON r.ticker = n_name LEFT JOIN k ON k.ticker = n_name
  LEFT JOIN t ON t.ticker = n_name LEFT JOIN n ON n.ticker = n_name""")
def q_briefing_full(spark, sf):
    """The whole briefing of every nation's instrument; those without bars, company or news included."""
    nat = D.read_table(spark, sf, "nation", "n_nationkey", "n_name")
    digest = P.news_digest(P.news_flatten(D.news_nested(spark, sf), 10), 6, 160)
    digest = digest.join(F.broadcast(nat), digest.ticker == nat.n_nationkey).select(C("n_name").alias("ticker"), "digest")
    return P.briefing(nat.select(C("n_name").alias("ticker")), P.company_profile(D.nation_info(spark, sf)), more.q_fixed_latest(spark, sf), more.q_fixed_importance_text(spark, sf),
                      q_returns_text(spark, sf), q_risk_metrics(spark, sf).select("ticker", *RISK_COLS), more.q_trend_text(spark, sf), digest)
