"""SQL twins of the derived views and indicators, written independently of the
Spark code (plain window functions; EWM as an exact recursive CTE). Used as the
DuckDB oracle: tables region nation customer supplier part orders lineitem events
documents embeddings pages benchmark labels conversations are views there."""

from __future__ import annotations

TIE = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"

BARS = f"""bars AS (
  SELECT n_name AS ticker, r_name AS sector, l_shipdate AS ts,
         arg_min(l_extendedprice, {TIE}) AS open,
         max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         arg_max(l_extendedprice, {TIE}) AS close,
         sum(l_quantity) AS volume
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY n_name, r_name, l_shipdate)"""

BARS_SECTOR = f"""bars AS (
  SELECT r_name AS ticker, r_name AS sector, l_shipdate AS ts,
         arg_min(l_extendedprice, {TIE}) AS open,
         max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         arg_max(l_extendedprice, {TIE}) AS close,
         sum(l_quantity) AS volume
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY r_name, l_shipdate)"""

EVENT_BARS = """ebars AS (
  SELECT event_type AS ticker, date_trunc('hour', ts) AS ts,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY event_type, date_trunc('hour', ts))"""

# Position within ticker.
BP = """bp AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS pos,
         count(*) OVER (PARTITION BY ticker) AS n_rows
  FROM bars)"""


def roll(expr: str, n: int, fn: str = "avg") -> str:
    frame = f"(PARTITION BY ticker ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({expr}) OVER {frame} = {n} THEN {fn}({expr}) OVER {frame} END"


W = "(PARTITION BY ticker ORDER BY ts)"

# Level 1: everything computed directly from the bar columns.
L1 = f"""l1 AS (
  SELECT *, lag(close) OVER {W} AS prev,
         {roll('close', 50)} AS sma_50,
         {roll('close', 200)} AS sma_200,
         {roll('close', 20)} AS m20,
         {roll('close', 20, 'stddev_samp')} AS s20,
         {roll('volume', 20)} AS v20,
         {roll('low', 14, 'min')} AS lo14,
         {roll('high', 14, 'max')} AS hi14,
         max(close) OVER (PARTITION BY ticker ORDER BY ts
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak
  FROM bp)"""

L2 = """l2 AS (
  SELECT *,
         CASE WHEN close - prev > 0 THEN close - prev ELSE 0.0 END AS gain,
         CASE WHEN close - prev < 0 THEN prev - close ELSE 0.0 END AS loss,
         close / NULLIF(prev, 0) - 1 AS daily_return,
         m20 + 2 * s20 AS bb_upper, m20 - 2 * s20 AS bb_lower,
         volume / NULLIF(v20, 0) AS volume_ratio,
         greatest(high - low, abs(high - prev), abs(low - prev)) AS tr,
         100.0 * ((close - lo14) / NULLIF(hi14 - lo14, 0)) AS stoch_k,
         (close - peak) / NULLIF(peak, 0) * 100 AS drawdown
  FROM l1)"""

L3 = f"""l3 AS (
  SELECT *,
         (close - bb_lower) / NULLIF(bb_upper - bb_lower, 0) AS bb_position,
         {roll('gain', 14)} AS ag, {roll('loss', 14)} AS al,
         {roll('daily_return', 30, 'stddev_samp')} AS volatility,
         {roll('tr', 14)} AS atr,
         {roll('stoch_k', 3)} AS stoch_d
  FROM l2)"""

# Exact EWM (adjust=True) by recursion over the position: numerator and
# denominator of spans 12, 26, 20 on close and span 9 on the MACD line.
EWM = """ewr(ticker, pos, n12, d12, n26, d26, n20, d20, ns, ds) AS (
  SELECT ticker, pos, close, 1.0::DOUBLE, close, 1.0::DOUBLE, close, 1.0::DOUBLE,
         0.0::DOUBLE, 1.0::DOUBLE
  FROM bp WHERE pos = 0
  UNION ALL
  SELECT b.ticker, b.pos,
         e.n12 * (11.0::DOUBLE / 13) + b.close, e.d12 * (11.0::DOUBLE / 13) + 1,
         e.n26 * (25.0::DOUBLE / 27) + b.close, e.d26 * (25.0::DOUBLE / 27) + 1,
         e.n20 * (19.0::DOUBLE / 21) + b.close, e.d20 * (19.0::DOUBLE / 21) + 1,
         e.ns * 0.8::DOUBLE + ((e.n12 * (11.0::DOUBLE / 13) + b.close) / (e.d12 * (11.0::DOUBLE / 13) + 1)
                               - (e.n26 * (25.0::DOUBLE / 27) + b.close) / (e.d26 * (25.0::DOUBLE / 27) + 1)),
         e.ds * 0.8::DOUBLE + 1
  FROM ewr e JOIN bp b ON b.ticker = e.ticker AND b.pos = e.pos + 1),
ew AS (
  SELECT ticker, pos, n12 / d12 - n26 / d26 AS macd, ns / ds AS macd_signal,
         n12 / d12 - n26 / d26 - ns / ds AS macd_hist, n20 / d20 AS ema_20
  FROM ewr)"""

IND = """ind AS (
  SELECT l3.ticker, l3.sector, l3.ts, l3.pos, l3.n_rows, l3.open, l3.high, l3.low, l3.close,
         l3.volume,
         CASE WHEN al = 0 THEN (CASE WHEN ag > 0 THEN 100.0 END)
              ELSE 100.0 - 100.0 / (1.0 + ag / al) END AS rsi,
         ew.macd, ew.macd_signal, ew.macd_hist,
         bb_upper, bb_lower, bb_position, sma_50, sma_200, volume_ratio, volatility,
         daily_return, ew.ema_20, atr, stoch_k, stoch_d, drawdown
  FROM l3 JOIN ew ON l3.ticker = ew.ticker AND l3.pos = ew.pos)"""

INDICATORS = [BP, L1, L2, L3, EWM, IND]


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"

LABEL = """lab AS (
  SELECT *, lead(close, 30) OVER (PARTITION BY ticker ORDER BY ts) / close - 1 AS future_return
  FROM ind),
lab2 AS (SELECT *, (future_return > 0)::INTEGER AS target FROM lab)"""

LABEL_COMPAT = """labc AS (SELECT *, coalesce((future_return > 0)::INTEGER, 0) AS target_c FROM lab)"""

USABLE = """usable AS (
  SELECT * FROM lab2
  WHERE rsi IS NOT NULL AND macd IS NOT NULL AND macd_hist IS NOT NULL
    AND bb_position IS NOT NULL AND volume_ratio IS NOT NULL AND volatility IS NOT NULL
    AND daily_return IS NOT NULL AND target IS NOT NULL)"""

SPLIT = """spl AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS ri,
         count(*) OVER (PARTITION BY ticker) AS un
  FROM usable),
parts AS (
  SELECT *, CASE WHEN ri < greatest(floor(un * 0.8::DOUBLE) - 30, 0) THEN 'train'
                 WHEN ri < floor(un * 0.8::DOUBLE) THEN 'embargo' ELSE 'test' END AS part
  FROM spl)"""

PREDS = """preds AS (
  SELECT ticker, sector, ts, target, macd_hist AS score, (macd_hist > 0)::INTEGER AS prediction
  FROM parts WHERE part = 'test')"""

BASE_PREDS = """preds AS (
  SELECT ticker, sector, ts, target, 1.0::DOUBLE AS score, 1 AS prediction
  FROM parts WHERE part = 'test')"""

TRAINING = [BP, L1, L2, L3, EWM, IND, LABEL, USABLE, SPLIT]

COUNTS = """cm AS (
  SELECT count_if(target = 0 AND prediction = 0) AS tn, count_if(target = 0 AND prediction = 1) AS fp,
         count_if(target = 1 AND prediction = 0) AS fn, count_if(target = 1 AND prediction = 1) AS tp
  FROM preds)"""

EVAL = """ev AS (
  SELECT tn + fp + fn + tp AS test_rows,
         (tn + tp) / NULLIF((tn + fp + fn + tp)::DOUBLE, 0) AS accuracy,
         (fn + tp) / NULLIF((tn + fp + fn + tp)::DOUBLE, 0) AS baseline_always_up_acc,
         coalesce(tn / NULLIF((tn + fn)::DOUBLE, 0), 0.0) AS down_precision,
         coalesce(tn / NULLIF((tn + fp)::DOUBLE, 0), 0.0) AS down_recall
  FROM cm)
SELECT test_rows, round(accuracy, 8) AS accuracy,
       round(baseline_always_up_acc, 8) AS baseline_always_up_acc,
       round((accuracy - baseline_always_up_acc) * 100, 6) AS lift_over_baseline_pp,
       round(down_precision, 8) AS down_precision, round(down_recall, 8) AS down_recall,
       round(coalesce(2 * down_precision * down_recall / NULLIF(down_precision + down_recall, 0), 0.0), 8) AS down_f1
FROM ev"""

PROFILE = """profile AS (
  SELECT n_name AS ticker, r_name AS sector, sum_c * 1e6 AS market_cap, avg_s / 100 AS trailing_pe,
         avg_c / NULLIF(avg_s, 0) - 1 AS revenue_growth, n_s::DOUBLE / NULLIF(n_c, 0) AS profit_margin
  FROM nation JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT s_nationkey, avg(s_acctbal) AS avg_s, count(*) AS n_s FROM supplier GROUP BY s_nationkey) s
    ON n_nationkey = s.s_nationkey
  LEFT JOIN (SELECT c_nationkey, sum(c_acctbal) AS sum_c, avg(c_acctbal) AS avg_c, count(*) AS n_c
             FROM customer GROUP BY c_nationkey) c ON n_nationkey = c.c_nationkey)"""

ALIASES = """aliases AS (
  SELECT DISTINCT alias, ticker FROM (
    SELECT lower(n_name) AS alias, n_name AS ticker FROM nation
    UNION ALL SELECT replace(lower(n_name), '_', ' '), n_name FROM nation))"""

ALIAS_QUERIES = """aq AS (
  SELECT n_nationkey AS query_id,
         '  ' || CASE WHEN n_nationkey % 2 = 0 THEN replace(n_name, '_', ' ') ELSE n_name END
              || (['' || ' inc.', ' corp', ' group', ' ltd', '', ' widgets'])[n_nationkey % 6 + 1] AS query
  FROM nation)"""

QUOTES = """quotes AS (
  SELECT 'P' || p_partkey AS symbol, p_name AS name,
         CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 'ETF' WHEN 'PROMO' THEN 'MUTUALFUND'
              WHEN 'SMALL' THEN 'INDEX' ELSE 'EQUITY' END AS kind
  FROM part)"""

SEARCH_QUERIES = """aq AS (
  SELECT p_partkey AS query_id,
         CASE p_partkey % 4
              WHEN 0 THEN '  ' || left(p_name, (1 + p_partkey % greatest(length(p_name), 1))::INTEGER)
              WHEN 1 THEN upper(split_part(p_name, ' ', 1))
              WHEN 2 THEN 'p' || (p_partkey // 7)
              ELSE p_name || ' widgets' END AS query
  FROM part)"""

NEWS = """news AS (
  SELECT conv_id AS ticker, turn AS position, split_part(text, chr(10), 1) AS title, role AS publisher,
         text AS summary FROM conversations)"""

RUN_LOG = """run_log AS (
  SELECT l_returnflag AS period, date_trunc('month', l_shipdate) AS retrained_at,
         count(*) AS total_rows, avg((l_discount > 0.05)::DOUBLE) AS accuracy,
         avg((l_quantity > 25)::DOUBLE) AS baseline_always_up_acc
  FROM lineitem GROUP BY l_returnflag, date_trunc('month', l_shipdate))"""

WS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
      r"\x{202f}\x{205f}\x{3000}]")

FUNDAMENTALS = """fundamentals AS (
  SELECT n_name AS ticker, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS as_of,
         sum(o_totalprice) AS revenue, count(*) AS n_orders
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name, date_trunc('month', o_orderdate))"""
