"""Further registered queries: the bar store, fuzzy search, and a fixed ensemble that SQL can follow value by value."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.operators import boost as B
from pricelens.operators import report as P
from pricelens.operators import resolve as R
from pricelens.operators import training as T
from pricelens.operators.signals import confidence_text
from pricelens.plans import sql as S
from pricelens.plans.catalog import latest_features, register, rnd, split_frame
from pricelens.schema import FEATURES_7
from pricelens.session import shared_folder
from pricelens.sources import derived as D
from pricelens.sources import store
from pricelens.sources.bars import restrict_period
from pricelens.operators import labels as L

C = F.col

# --------------------------------------------------------------------------- bar store
#: What the query on landed bars asks for (fixed values of this query).
SINCE, UNTIL = dt.datetime(1996, 3, 10), dt.datetime(1997, 2, 20)


def landed(spark, sf) -> str:
    """A store of all bars, landed with a wrong last year and corrected by its months."""
    bars, path = D.bars(spark, sf), shared_folder(spark, "bars")
    wrong = F.col("ts") >= F.lit(dt.datetime(1996, 1, 1)).cast("timestamp_ntz")
    store.land_bars(bars.withColumn("volume", F.when(wrong, C("volume") + 1).otherwise(C("volume"))), path)
    store.land_bars(bars.where(wrong), path)
    return path


@register("bars_landed", S.with_(S.BARS) + f"""
SELECT ticker, sector, ts, open, high, low, close, volume FROM bars WHERE ts >= '{SINCE}' AND ts < '{UNTIL}'""")
def q_bars_landed(spark, sf):
    """Bars of a stretch of time out of the store: whole folders of other months are left out."""
    return store.read_store(spark, landed(spark, sf), SINCE, UNTIL)


TICKER_QUERIES = """tq AS (SELECT n_nationkey AS query_id, CASE n_nationkey % 3 WHEN 0 THEN lower(r_name) || ' ' WHEN 1 THEN r_name ELSE 'NOPE' END AS query
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@register("resolve_literal", S.with_(S.BARS_SECTOR, TICKER_QUERIES) + """,
r AS (SELECT ticker FROM bars GROUP BY ticker HAVING max(ts) >= (SELECT max(ts) FROM bars) - INTERVAL 5 DAY)
SELECT query_id, query, r.ticker, CASE WHEN r.ticker IS NOT NULL THEN 'literal' END AS stage
FROM tq LEFT JOIN r ON r.ticker = upper(trim(query)) AND length(trim(query)) <= 6
  AND regexp_full_match(replace(replace(upper(trim(query)), '-', ''), '.', ''), '\\p{L}+')""")
def q_resolve_literal(spark, sf):
    """Tickers given as they are, probed in the store's table of newest dates: no tick and no bar is read for it."""
    path = shared_folder(spark, "bars")
    store.land_bars(D.bars_sector(spark, sf), path)
    reg = D.read_table(spark, sf, "region", "r_regionkey", "r_name")
    nat = D.read_table(spark, sf, "nation", "n_nationkey", "n_regionkey").join(reg, C("n_regionkey") == C("r_regionkey"))
    k = F.pmod(C("n_nationkey"), F.lit(3))
    q = F.when(k == 0, F.concat(F.lower("r_name"), F.lit(" "))).when(k == 1, C("r_name")).otherwise("NOPE")
    queries = nat.select(C("n_nationkey").alias("query_id"), q.alias("query"))
    none = D.aliases(spark, sf).where("alias is null")
    return R.resolve(queries, none, store.recent(spark, path))


# --------------------------------------------------------------------------- fuzzy search
MISSPELT = """mq AS (SELECT p_partkey AS query_id, CASE p_partkey % 5
    WHEN 0 THEN left(p_name, 2) || substr(p_name, 4)
    WHEN 1 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ')
    WHEN 2 THEN substr(l, 1, 1) || substr(l, 3, 1) || substr(l, 2, 1) || substr(l, 4)
    WHEN 3 THEN p_name || ' zzzzzz' ELSE p_name END AS query
  FROM (SELECT *, string_split(p_name, ' ')[-1] AS l FROM part))"""


@register("resolve_fuzzy", S.with_(S.QUOTES, MISSPELT) + r""",
qs AS (SELECT DISTINCT lower(trim(query)) AS q FROM mq),
qw AS (SELECT DISTINCT q, unnest(regexp_extract_all(q, '[\p{L}\p{Nd}]+')) AS word FROM qs),
nw AS (SELECT DISTINCT symbol, kind, unnest(regexp_extract_all(lower(name), '[\p{L}\p{Nd}]+')) AS w FROM quotes),
near AS (SELECT word, w, levenshtein(word, w) AS d FROM (SELECT DISTINCT word FROM qw), (SELECT DISTINCT w FROM nw)
         WHERE levenshtein(word, w) <= CASE WHEN length(word) >= 6 THEN 2 WHEN length(word) >= 3 THEN 1 ELSE 0 END),
one AS (SELECT q, qw.word, symbol, kind, min(d) AS d FROM qw JOIN near USING (word) JOIN nw USING (w) GROUP BY ALL),
n AS (SELECT q, count(*) AS n FROM qw GROUP BY q),
m AS (SELECT symbol, count(*) AS m FROM nw GROUP BY symbol),
s AS (SELECT q, symbol, kind, sum(d) * 10 + greatest(any_value(m) - any_value(n), 0) AS score
      FROM one JOIN n USING (q) JOIN m USING (symbol) GROUP BY q, symbol, kind HAVING count(*) = any_value(n)),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score, symbol) AS rk FROM s),
p AS (SELECT q, arg_min(upper(symbol), rk) AS ticker, arg_min(score, rk)::BIGINT AS score FROM k WHERE rk <= 3 AND kind IN ('EQUITY', 'ETF') GROUP BY q)
SELECT query_id, query, p.ticker, p.score FROM mq LEFT JOIN p ON p.q = lower(trim(query))""")
def q_resolve_fuzzy(spark, sf):
    """Misspelt and turned-round names against all quotes; the SQL computes every distance."""
    return R.resolve_fuzzy(D.misspelt_queries(spark, sf), D.quotes(spark, sf))


# --------------------------------------------------------------------------- a fixed ensemble
def _leaf(up: int):
    return ("leaf", float(up), [1.0, 1.0])


#: Three stages: (alpha, tree), a split being (feature, threshold, tree at or below, tree above). Fixed values.
FIXED = [
    (0.9, ("rsi", 47.13, ("bb_position", 0.2171, 1, 0), ("macd_hist", 13.37, 0, 1))),
    (0.55, ("volatility", 0.41237, ("daily_return", 0.01713, 1, 0), 0)),
    (0.4, ("volume_ratio", 0.87123, 0, ("macd", -7.31, 1, 0))),
]
#: Importances of each stage by feature. Fixed values.
FIXED_IMPORTANCE = [{"rsi": 0.6, "bb_position": 0.25, "macd_hist": 0.15}, {"volatility": 0.7, "daily_return": 0.3}, {"volume_ratio": 0.8, "macd": 0.2}]


def fixed_model() -> B.SammeModel:
    def spec(t):
        return _leaf(t) if isinstance(t, int) else ("split", FEATURES_7.index(t[0]), t[1], spec(t[2]), spec(t[3]))
    return B.SammeModel(FEATURES_7, [a for a, _ in FIXED], [spec(t) for _, t in FIXED], [[i.get(f, 0.0) for f in FEATURES_7] for i in FIXED_IMPORTANCE])


SCORED_SQL = """,
v AS (SELECT *,
  CASE WHEN rsi <= 47.13 THEN CASE WHEN bb_position <= 0.2171 THEN 1 ELSE 0 END ELSE CASE WHEN macd_hist <= 13.37 THEN 0 ELSE 1 END END AS v1,
  CASE WHEN volatility <= 0.41237 THEN CASE WHEN daily_return <= 0.01713 THEN 1 ELSE 0 END ELSE 0 END AS v2,
  CASE WHEN volume_ratio <= 0.87123 THEN 0 ELSE CASE WHEN macd <= -7.31 THEN 1 ELSE 0 END END AS v3 FROM src),
d AS (SELECT *, ((2 * v1 - 1) * 0.9::DOUBLE + (2 * v2 - 1) * 0.55::DOUBLE + (2 * v3 - 1) * 0.4::DOUBLE) / 1.85::DOUBLE AS decision FROM v),
sc AS (SELECT *, (decision > 0)::INTEGER AS prediction, 1 / (1 + exp(-2 * decision)) AS p_up FROM d),
fin AS (SELECT *, greatest(p_up, 1 - p_up) * 100 AS confidence, CASE WHEN prediction = 1 THEN 'UP' ELSE 'DOWN' END AS direction FROM sc)"""
TEST_ROWS = S.with_(S.BARS, *S.TRAINING, "src AS (SELECT * FROM parts WHERE part = 'test')", recursive=True)
WORDED = "CASE WHEN round(confidence, 9) > 60 THEN 'high' WHEN round(confidence, 9) > 55 THEN 'moderate' ELSE 'low' END AS confidence_text"


def fixed_scores(spark, sf) -> DataFrame:
    return fixed_model().transform(split_frame(spark, sf).where(C("part") == "test"))


@register("fixed_scores", TEST_ROWS + SCORED_SQL + f"""
SELECT ticker, ts, round(decision, 8) AS decision, prediction, round(p_up, 8) AS p_up, round(confidence, 6) AS confidence, direction, {WORDED} FROM fin""")
def q_fixed_scores(spark, sf):
    """Decision, probability, class and wording of every test row."""
    d = fixed_scores(spark, sf).select("ticker", "ts", "decision", "prediction", "p_up", "confidence", "direction",
                                       confidence_text(F.round("confidence", 9)).alias("confidence_text"))
    return rnd(d, {"decision": 8, "p_up": 8, "confidence": 6})


LATEST_SQL = S.with_(S.BARS, *S.INDICATORS, recursive=True) + """,
ok AS (SELECT * FROM ind WHERE n_rows >= 200 AND pos = n_rows - 1),
src AS (SELECT ticker, ts, close, """ + ", ".join(f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0.0 ELSE {c} END AS {c}" for c in FEATURES_7) + " FROM ok)"


@register("fixed_latest", LATEST_SQL + SCORED_SQL + f"""
SELECT ticker, ts, close, prediction, direction, round(confidence, 4) AS confidence, {WORDED} FROM fin""")
def q_fixed_latest(spark, sf):
    """The newest bar of every instrument, scored."""
    s = fixed_model().transform(latest_features(spark, sf))
    return s.select("ticker", "ts", "close", "prediction", "direction", F.round("confidence", 4).alias("confidence"),
                    confidence_text(F.round("confidence", 9)).alias("confidence_text"))


_WEIGHTS = {f: f"({' + '.join(f'{a} * {i.get(f, 0.0)}' for (a, _), i in zip(FIXED, FIXED_IMPORTANCE))})::DOUBLE / 1.85" for f in FEATURES_7}


@register("fixed_importance_text", LATEST_SQL + """,
w AS (SELECT unnest([""" + ", ".join(f"'{f}'" for f in FEATURES_7) + "]) AS feature, unnest([" + ", ".join(_WEIGHTS[f] for f in FEATURES_7) + """]) AS importance),
k AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM w),
l AS (UNPIVOT (SELECT ticker, """ + ", ".join(f"{f}::DOUBLE AS {f}" for f in FEATURES_7) + " FROM src) ON " + ", ".join(FEATURES_7) + """ INTO NAME feature VALUE v)
SELECT ticker, string_agg(printf('  %d. %s: %.1f%% importance — current value: %.4f', rank, feature, importance * 100, v), chr(10) ORDER BY rank) AS importance_text
FROM l JOIN k USING (feature) GROUP BY ticker""")
def q_fixed_importance_text(spark, sf):
    """Importances of the stages, weighted by alpha, beside every instrument's current values."""
    lf = latest_features(spark, sf).select("ticker", *FEATURES_7)
    return P.importance_lines(lf, T.importance_table(spark, fixed_model()))


@register("fixed_metrics", TEST_ROWS + SCORED_SQL + """,
preds AS (SELECT sector, target, prediction, p_up AS score FROM fin), """ + S.COUNTS + """,
e AS (SELECT tn, fp, fn, tp, (tn + fp + fn + tp)::DOUBLE AS n FROM cm),
a AS (SELECT round(score, 12) AS s, count_if(target = 1) AS pos, count_if(target = 0) AS neg FROM preds GROUP BY round(score, 12)),
b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM a)
SELECT (tn + tp) / n AS accuracy, (fn + tp) / n AS baseline, round(((tn + tp) / n - (fn + tp) / n) * 100, 6) AS lift, tn, fp, fn, tp,
       (SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)), 8) FROM b) AS roc_auc,
       round(coalesce(tn / NULLIF((tn + fn)::DOUBLE, 0), 0), 8) AS down_precision, round(coalesce(tn / NULLIF((tn + fp)::DOUBLE, 0), 0), 8) AS down_recall,
       (SELECT count(*) FROM parts WHERE part = 'train') AS train_rows, (SELECT count(*) FROM parts WHERE part = 'test') AS test_rows,
       (SELECT round(avg(target) * 100, 6) FROM parts WHERE part = 'train') AS train_up_pct, (SELECT round(avg(target) * 100, 6) FROM parts WHERE part = 'test') AS test_up_pct,
       (SELECT count(*) FROM bars) AS total_rows, (SELECT string_agg(DISTINCT ticker, ',' ORDER BY ticker) FROM bars) AS tickers_used,
       (SELECT string_agg(sector || '=' || x, ',' ORDER BY sector) FROM (SELECT sector, printf('%.6f', avg((target = prediction)::INTEGER)) AS x FROM preds GROUP BY sector)) AS sector_accuracy
FROM e""")
def q_fixed_metrics(spark, sf):
    """The metrics record of a run with the fixed ensemble, its nested columns shown as text."""
    bars = L.min_history(restrict_period(D.bars(spark, sf), 100), 1)
    split = split_frame(spark, sf).where(C("part") != "embargo")
    model = fixed_model()
    scored = model.transform(split.where(C("part") == "test")).withColumn("p_up", F.round("p_up", 12))
    rows = bars.groupBy("ticker").agg(F.count("*").alias("n_rows"))
    r = T.metrics_record(split, scored, model, D.universe(spark, sf), rows)
    sectors = F.array_join(F.transform(F.sort_array(F.map_keys("sector_accuracy")), lambda s: F.concat(s, F.lit("="), F.format_string("%.6f", F.element_at(C("sector_accuracy"), s)))), ",")
    out = r.select("accuracy", C("baseline_always_up_acc").alias("baseline"), C("lift_over_baseline_pp").alias("lift"), "confusion_matrix.*", "roc_auc", "down_precision",
                   "down_recall", "train_rows", "test_rows", "train_up_pct", "test_up_pct", "total_rows", F.array_join("tickers_used", ",").alias("tickers_used"), sectors.alias("sector_accuracy"))
    return rnd(out, {"lift": 6, "roc_auc": 8, "down_precision": 8, "down_recall": 8, "train_up_pct": 6, "test_up_pct": 6})


# --------------------------------------------------------------------------- indicator state
#: Ends of the micro-batches in which the query replays the bars (fixed values of this query).
EPOCHS = [dt.datetime(1993, 5, 1), dt.datetime(1996, 1, 1), dt.datetime(1998, 6, 1), dt.datetime(2100, 1, 1)]
STATE_ROUND = {"rsi": 4, "macd": 2, "macd_hist": 2, "bb_position": 6, "volume_ratio": 6, "volatility": 6, "daily_return": 8, "sma_50": 6, "sma_200": 6, "drawdown": 6}


@register("state_features", S.with_(S.BARS, *S.INDICATORS, recursive=True) + """
SELECT ticker, ts, close, n_rows, """ + ", ".join(f"round({c}, {n}) AS {c}" for c, n in STATE_ROUND.items()) + """
FROM ind WHERE pos = n_rows - 1""")
def q_state_features(spark, sf):
    """Indicators of every newest bar out of a state that took the bars in batches, each batch with the one before again."""
    from pricelens.streaming import state as ST
    bars, now, path = D.bars(spark, sf), ST.empty_state(spark), shared_folder(spark, "state")
    for epoch, end in enumerate(EPOCHS):
        start = EPOCHS[epoch - 2] if epoch > 1 else dt.datetime(1900, 1, 1)
        batch = bars.where((C("ts") >= F.lit(start).cast("timestamp_ntz")) & (C("ts") < F.lit(end).cast("timestamp_ntz")))
        ST.advance(now, batch, epoch).write.parquet(f"{path}/epoch={epoch}")
        now = ST.read_state(spark, path)
    return rnd(ST.features(now).select("ticker", "ts", "close", "n_rows", *STATE_ROUND), STATE_ROUND)


# --------------------------------------------------------------------------- company texts
INFO = """info AS (SELECT s_name AS ticker, CASE WHEN s_suppkey % 5 > 0 THEN s_name || ' Ltd' END AS longName, CASE WHEN s_suppkey % 4 > 0 THEN 'Industry ' || s_suppkey % 4 END AS industry,
  (['buy', 'hold', NULL, ''])[s_suppkey % 4 + 1] AS recommendationKey, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey * 37 END AS fullTimeEmployees,
  CASE WHEN s_suppkey % 3 < 2 THEN s_suppkey END AS numberOfAnalystOpinions,
  CASE WHEN s_suppkey % 6 > 0 THEN repeat(s_name || ' é ', s_suppkey % 50 + 1) END AS longBusinessSummary, """ + ", ".join(
    f"CASE (s_suppkey * 3 + {i}) % 6 WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN s_acctbal / 1e7 WHEN 3 THEN s_acctbal / -1000 WHEN 4 THEN s_acctbal * {i} WHEN 5 THEN s_acctbal * 1e6 END AS {f}"
    for i, f in enumerate(D.INFO_NUMBERS)) + " FROM supplier)"
SHOWN = {
    "num": "coalesce(printf('%.2f', {0}), 'N/A')", "usd": "coalesce('$' || printf('%.2f', {0}), 'N/A')", "pct": "coalesce(printf('%.1f%%', {0} * 100), 'N/A')",
    "smart": "CASE WHEN {0} IS NULL THEN 'N/A' WHEN {0} = 0 THEN '0.0%' WHEN abs({0}) >= 1 THEN printf('%.2f%%', {0}) ELSE printf('%.2f%%', {0} * 100) END",
    "billions": "CASE WHEN {0} <> 0 THEN printf('$%.1fB', {0} / 1e9) ELSE 'N/A' END", "word": "coalesce(upper(nullif({0}, '')), 'N/A')", "plain": "coalesce({0}::VARCHAR, 'N/A')",
}


@register("fundamentals_cards", S.with_(INFO) + " UNION ALL ".join(
    f"SELECT ticker, '{s}' AS section, {k} AS position, '{label}' AS label, {SHOWN[kind].format(f)} AS value FROM info" for k, (s, label, f, kind) in enumerate(P.CARDS)))
def q_fundamentals_cards(spark, sf):
    """All cards of every company, with missing, zero, negative and large figures."""
    return P.fundamentals_cards(D.company_info(spark, sf))


def profile_sql(sector: str = "'Unknown'") -> str:
    return """
SELECT ticker, concat_ws(chr(10), 'COMPANY: ' || coalesce(longName, ticker), 'SECTOR: ' || """ + sector + """, 'INDUSTRY: ' || coalesce(industry, 'Unknown'),
  'MARKET CAP: $' || CASE WHEN marketCap < 0 THEN '-' ELSE '' END || format('{:,}', abs(round_even(coalesce(marketCap, 0), 0)::BIGINT)),
  '52W RANGE: $' || printf('%.2f', coalesce(fiftyTwoWeekLow, 0)) || ' – $' || printf('%.2f', coalesce(fiftyTwoWeekHigh, 0)),
  'EMPLOYEES: ' || coalesce(fullTimeEmployees::VARCHAR, 'N/A'), 'DESCRIPTION: ' || left(coalesce(longBusinessSummary, ''), 600), """ + ", ".join(
    f"'{label}: {'$' if f == 'targetMeanPrice' else ''}' || coalesce({f}::VARCHAR, 'N/A')" for label, f in P.PLAIN_LINES) + """) AS profile FROM info"""


@register("company_profile", S.with_(INFO) + profile_sql())
def q_company_profile(spark, sf):
    """Head of the briefing and its block of figures."""
    return P.company_profile(D.company_info(spark, sf))


@register("trend_text", S.with_(S.BARS, *S.INDICATORS, recursive=True) + """,
t AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS previous FROM ind),
z AS (SELECT ticker, close, previous, coalesce(sma_50, 0) AS sma_50, coalesce(sma_200, 0) AS sma_200, coalesce(rsi, 0) AS rsi, coalesce(stoch_k, 0) AS stoch_k, coalesce(atr, 0) AS atr
      FROM t WHERE pos = n_rows - 1)
SELECT ticker, printf('CURRENT PRICE: $%.2f (today %+.2f%%)', close, coalesce((close - previous) / nullif(previous, 0) * 100, 0)) || chr(10)
  || printf('SMA 50: $%.2f SMA 200: $%.2f', round(sma_50, 6), round(sma_200, 6)) || chr(10) || printf('RSI: %.1f Stochastic %%K: %.1f', rsi, stoch_k) || chr(10)
  || printf('ATR: %.2f', round(atr, 6)) || chr(10) || 'Trend: ' || CASE WHEN sma_50 > sma_200 THEN 'GOLDEN CROSS (bullish)' ELSE 'DEATH CROSS (bearish)' END AS trend FROM z""")
def q_trend_text(spark, sf):
    """Trend block of every newest bar."""
    from pricelens.operators import indicators as I
    from pricelens.operators.summary import with_extent
    d = with_extent(I.lag_col(I.indicators_full(D.bars(spark, sf)), 1, "close", "previous")).where("rpos = 0")
    return P.trend_lines(rnd(d, {"sma_50": 6, "sma_200": 6, "atr": 6}))
