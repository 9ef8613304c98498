"""Text built from tables, for all tickers at once: news rows and digest, returns
line, importance lines, fundamentals block, report line classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.scalar import fixed, fmt_num, fmt_pct, truncate_text

C = F.col

# Characters Python's str.strip() removes (str.isspace) (fixed values).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(x) -> F.Column:
    return F.btrim(x, F.lit(WS_CHARS))


def news_flatten(items: DataFrame, k: int = 10) -> DataFrame:
    """Nested provider items ``(ticker, position, item)`` -> flat rows, first ``k``
    per ticker, every missing level defaulted to ''."""
    c = C("item.content")
    flat = items.select(
        "ticker", "position",
        F.coalesce(c.getField("title"), F.lit("")).alias("title"),
        F.coalesce(c.getField("provider").getField("displayName"), F.lit("")).alias("publisher"),
        F.coalesce(c.getField("summary"), F.lit("")).alias("summary"),
        F.coalesce(c.getField("pubDate"), F.lit("")).alias("date"),
        F.coalesce(c.getField("canonicalUrl").getField("url"), F.lit("")).alias("link"))
    w = Window.partitionBy("ticker").orderBy("position")
    return flat.withColumn("rank", F.row_number().over(w)).where(C("rank") <= k)


def news_digest(flat: DataFrame, k: int = 6, width: int = 160) -> DataFrame:
    """'- [publisher] title: summary[:width]' for the first ``k`` items with a
    non-empty title, newline-joined per ticker (at most k items collected)."""
    f = flat.where((C("rank") <= k) & (F.length("title") > 0))
    line = F.concat(F.lit("- ["), C("publisher"), F.lit("] "), C("title"), F.lit(": "),
                    truncate_text(C("summary"), width))
    g = f.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("position", line.alias("l"))))
                                .alias("xs"))
    return g.select("ticker", F.array_join(F.transform("xs", lambda x: x["l"]), "\n").alias("digest"))


def returns_text(returns_long: DataFrame) -> DataFrame:
    """'1D: +0.4% | 1W: -1.2% | ...' in horizon order."""
    part = F.concat(C("horizon"), F.lit(": "), fixed("ret_pct", 1, plus=True), F.lit("%"))
    g = returns_long.groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct("horizon_order", part.alias("p")))).alias("xs"))
    return g.select("ticker", F.array_join(F.transform("xs", lambda x: x["p"]), " | ").alias("returns_text"))


def fmt_pct_smart(x) -> F.Column:
    """'0.0%' for 0, '%.2f%%' of v when |v| >= 1 (already percent), else of v*100; 'N/A'."""
    d = x.try_cast("double")
    return (F.when(d.isNull() | F.isnan(d), F.lit("N/A"))
            .when(d == 0, F.lit("0.0%"))
            .otherwise(F.concat(fixed(F.when(F.abs(d) >= 1, d).otherwise(d * 100), 2), F.lit("%"))))


def profile_format(profile: DataFrame) -> DataFrame:
    """Display strings of the profile numbers; 'N/A' where missing."""
    return profile.select(
        "ticker",
        F.concat(F.lit("$"), fixed(F.coalesce(C("market_cap"), F.lit(0.0)) / 1e9, 1), F.lit("B")).alias("market_cap_text"),
        fmt_num(C("trailing_pe")).alias("pe_text"),
        fmt_pct(C("revenue_growth")).alias("growth_text"),
        fmt_pct(C("profit_margin")).alias("margin_text"))


def report_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Split report text into typed lines: '### ' heading, '- ' bullet, any other
    non-blank line a paragraph; blank lines dropped. Whole texts, one row per line."""
    e = docs.select(id_col, F.posexplode(F.split(C(text_col), "\n", -1)).alias("line_no", "raw"))
    s = e.withColumn("s", py_strip(C("raw")))
    kind = (F.when(C("s").startswith("### "), "heading").when(C("s").startswith("- "), "bullet")
            .when(F.length("s") > 0, "paragraph"))
    body = (F.when(C("s").startswith("### "), F.expr("substring(s, 5)"))
            .when(C("s").startswith("- "), F.expr("substring(s, 3)")).otherwise(C("s")))
    return (s.withColumn("kind", kind).where(C("kind").isNotNull())
             .select(id_col, "line_no", "kind", body.alias("content")))


def importance_lines(latest: DataFrame, imps: DataFrame) -> DataFrame:
    """Per ticker: '  {rank}. {feature}: {imp:.1f}% importance — current value: {v:.4f}'
    for every feature, newline-joined. ``imps(feature, importance, rank)`` is a
    handful of rows attached as one scalar array (no join)."""
    arr = imps.select(F.sort_array(F.collect_list(F.struct("rank", "feature", "importance")))).scalar()
    d = latest.withColumn("__imps", arr)
    vals = F.map_from_arrays(F.array(*[F.lit(c) for c in latest.columns if c != "ticker"]),
                             F.array(*[C(c).cast("double") for c in latest.columns if c != "ticker"]))
    line = lambda x: F.concat(F.lit("  "), x["rank"].cast("string"), F.lit(". "), x["feature"], F.lit(": "),
                              fixed(x["importance"] * 100, 1), F.lit("% importance — current value: "),
                              fixed(F.element_at(C("__vals"), x["feature"]), 4))
    d = d.withColumn("__vals", vals)
    return d.select("ticker", F.array_join(F.transform("__imps", line), "\n").alias("importance_text"))


def briefing_text(board: DataFrame, scored: DataFrame, risk: DataFrame, returns_txt: DataFrame,
                  importance_txt: DataFrame, fundamentals: DataFrame, digest: DataFrame) -> DataFrame:
    """Grounded briefing per ticker from one-row-per-ticker tables (equi-joins on
    ticker): profile, model output, importances, returns, risk, trend, fundamentals,
    news. Missing parts render as 'N/A' / empty."""
    na = lambda c, fmt: F.coalesce(F.format_string(fmt, c), F.lit("N/A"))
    d = (board.join(scored, "ticker", "left").join(risk, "ticker", "left")
         .join(returns_txt, "ticker", "left").join(importance_txt, "ticker", "left")
         .join(fundamentals, "ticker", "left").join(digest, "ticker", "left"))
    sections = [
        F.concat(F.lit("TICKER: "), C("ticker")),
        F.concat(F.lit("SECTOR: "), F.coalesce(C("sector"), F.lit("Unknown"))),
        F.concat(F.lit("CURRENT PRICE: "), na(C("close"), "$%.2f")),
        F.concat(F.lit("MARKET CAP: "), F.coalesce(C("market_cap_text"), F.lit("N/A"))),
        F.concat(F.lit("PREDICTION: "), F.coalesce(C("direction"), F.lit("N/A"))),
        F.concat(F.lit("CONFIDENCE: "), na(C("confidence"), "%.1f%%")),
        F.lit("INDICATOR IMPORTANCE & VALUES:"),
        F.coalesce(C("importance_text"), F.lit("")),
        F.lit("HISTORICAL RETURNS:"),
        F.coalesce(C("returns_text"), F.lit("")),
        F.concat(F.lit("Annualised Return: "), na(C("annual_return"), "%.1f%%")),
        F.concat(F.lit("Annualised Volatility: "), na(C("annual_volatility"), "%.1f%%")),
        F.concat(F.lit("Sharpe Ratio: "), na(C("sharpe"), "%.2f")),
        F.concat(F.lit("Sortino Ratio: "), na(C("sortino"), "%.2f")),
        F.concat(F.lit("Max Drawdown: "), na(C("max_drawdown"), "%.1f%%")),
        F.concat(F.lit("Positive Days: "), na(C("positive_days"), "%.1f%%")),
        F.concat(F.lit("RSI: "), na(C("rsi"), "%.1f"), F.lit("  Trend: "), C("trend")),
        F.concat(F.lit("P/E (trailing): "), F.coalesce(C("pe_text"), F.lit("N/A"))),
        F.concat(F.lit("Revenue Growth: "), F.coalesce(C("growth_text"), F.lit("N/A"))),
        F.concat(F.lit("Profit Margin: "), F.coalesce(C("margin_text"), F.lit("N/A"))),
        F.lit("RECENT NEWS:"),
        F.coalesce(C("digest"), F.lit("")),
    ]
    return d.select("ticker", F.concat_ws("\n", *sections).alias("briefing"))


# Labels of the fundamentals block and the profile field each one shows (fixed values).
FUNDAMENTAL_FIELDS = [
    ("P/E (trailing)", "trailing_pe"), ("P/E (forward)", "forward_pe"),
    ("PEG ratio", "peg_ratio"), ("Price/Book", "price_to_book"),
    ("Price/Sales", "price_to_sales"), ("Revenue Growth", "revenue_growth"),
    ("Earnings Growth", "earnings_growth"), ("Profit Margin", "profit_margin"),
    ("Operating Margin", "operating_margin"), ("ROE", "return_on_equity"),
    ("ROA", "return_on_assets"), ("Debt/Equity", "debt_to_equity"),
    ("Current Ratio", "current_ratio"), ("Dividend Yield", "dividend_yield"),
    ("Payout Ratio", "payout_ratio"), ("Beta", "beta"),
    ("Analyst Target", "target_mean_price"), ("Analyst Rating", "recommendation_key"),
]


def fundamentals_block(profile: DataFrame) -> DataFrame:
    """The 18-line fundamentals block per ticker: 'label: value' with numbers to two
    decimals, text as is, the target price with '$', and 'N/A' for absent fields."""
    cols = set(profile.columns)
    lines = []
    for label, field in FUNDAMENTAL_FIELDS:
        if field not in cols:
            val = F.lit("N/A")
        elif field == "recommendation_key":
            val = F.coalesce(C(field).cast("string"), F.lit("N/A"))
        else:
            val = fmt_num(C(field), 2, "$" if field == "target_mean_price" else "")
        lines.append(F.concat(F.lit(f"{label}: "), val))
    return profile.select("ticker", F.concat_ws("\n", *lines).alias("fundamentals"))


def news_cards(flat: DataFrame, width: int = 280) -> DataFrame:
    """Card text per item: summary cut to ``width`` characters plus '...' when cut,
    and the display date."""
    from pricelens.functions.scalar import news_date
    return flat.select("ticker", "position", "title",
                       truncate_text(C("summary"), width, "...").alias("summary_short"),
                       news_date(C("date")).alias("date_text"))


# Sections, labels, fields and formats of the fundamentals cards (fixed values).
CARDS = [
    ("Valuation", "P/E (trailing)", "trailingPE", "num"), ("Valuation", "P/E (forward)", "forwardPE", "num"), ("Valuation", "PEG ratio", "pegRatio", "num"),
    ("Valuation", "Price/Book", "priceToBook", "num"), ("Valuation", "Price/Sales", "priceToSalesTrailing12Months", "num"),
    ("Valuation", "EV/EBITDA", "enterpriseToEbitda", "num"), ("Valuation", "52w High", "fiftyTwoWeekHigh", "usd"), ("Valuation", "52w Low", "fiftyTwoWeekLow", "usd"),
    ("Growth", "Revenue Growth", "revenueGrowth", "pct"), ("Growth", "Earnings Growth", "earningsGrowth", "pct"), ("Growth", "EPS (TTM)", "trailingEps", "usd"),
    ("Growth", "Profit Margin", "profitMargins", "pct"), ("Growth", "Operating Margin", "operatingMargins", "pct"), ("Growth", "Gross Margin", "grossMargins", "pct"),
    ("Growth", "ROE", "returnOnEquity", "pct"), ("Growth", "ROA", "returnOnAssets", "pct"),
    ("Balance", "Debt/Equity", "debtToEquity", "num"), ("Balance", "Current Ratio", "currentRatio", "num"), ("Balance", "Quick Ratio", "quickRatio", "num"),
    ("Balance", "Total Cash", "totalCash", "billions"), ("Balance", "Total Debt", "totalDebt", "billions"), ("Balance", "Dividend Yield", "dividendYield", "smart"),
    ("Balance", "Payout Ratio", "payoutRatio", "pct"), ("Balance", "Beta", "beta", "num"),
    ("Analysts", "Avg target", "targetMeanPrice", "usd"), ("Analysts", "Low target", "targetLowPrice", "usd"), ("Analysts", "High target", "targetHighPrice", "usd"),
    ("Analysts", "Consensus", "recommendationKey", "word"), ("Analysts", "# Analysts", "numberOfAnalystOpinions", "plain"),
]
# Labels and fields of the briefing's block, whose values are printed as they are (fixed values).
PLAIN_LINES = [
    ("P/E (trailing)", "trailingPE"), ("P/E (forward)", "forwardPE"), ("PEG ratio", "pegRatio"), ("Price/Book", "priceToBook"),
    ("Price/Sales", "priceToSalesTrailing12Months"), ("Revenue Growth", "revenueGrowth"), ("Earnings Growth", "earningsGrowth"), ("Profit Margin", "profitMargins"),
    ("Operating Margin", "operatingMargins"), ("ROE", "returnOnEquity"), ("ROA", "returnOnAssets"), ("Debt/Equity", "debtToEquity"), ("Current Ratio", "currentRatio"),
    ("Dividend Yield", "dividendYield"), ("Payout Ratio", "payoutRatio"), ("Beta", "beta"), ("Analyst Target", "targetMeanPrice"), ("Analyst Rating", "recommendationKey"),
]


def plain(x) -> F.Column:
    """A number as its shortest decimal form, without exponent from 0.0001 up to 1e16: '0.0005', '12.0', '25000000.0', '7.3e-06'."""
    s = x.cast("string")
    digits = F.regexp_replace(s.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    digits = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    power = F.split_part(s, F.lit("E"), F.lit(2)).try_cast("int")
    short = F.concat(F.regexp_replace(F.split_part(s, F.lit("E"), F.lit(1)), r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"),
                     F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    return F.when(s.contains("E"), F.when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), digits).otherwise(short)).otherwise(s)


def _card(field: str, kind: str) -> F.Column:
    c = C(field)
    if kind == "word":
        return F.when(F.length(c) > 0, F.upper(c)).otherwise("N/A")
    if kind == "plain":
        return F.coalesce(c.cast("string"), F.lit("N/A"))
    if kind == "billions":  # zero counts as missing here
        return F.when(c != 0, F.concat(F.lit("$"), fixed(c / 1e9, 1), F.lit("B"))).otherwise("N/A")
    return {"num": lambda: fmt_num(c), "usd": lambda: fmt_num(c, 2, "$"), "pct": lambda: fmt_pct(c), "smart": lambda: fmt_pct_smart(c)}[kind]()


def fundamentals_cards(info: DataFrame) -> DataFrame:
    """(ticker, section, position, label, value): every card of each company's figures; a field that the table lacks is 'N/A'."""
    have = set(info.columns)
    cards = [F.struct(F.lit(s).alias("section"), F.lit(k).alias("position"), F.lit(label).alias("label"), (_card(f, kind) if f in have else F.lit("N/A")).alias("value"))
             for k, (s, label, f, kind) in enumerate(CARDS)]
    return info.select("ticker", F.explode(F.array(*cards)).alias("card")).select("ticker", "card.*")


def company_profile(info: DataFrame) -> DataFrame:
    """The head of a briefing: who the company is, its size and range, and the block of figures printed as they are."""
    have = set(info.columns)
    text = lambda f, other: F.coalesce(C(f), other) if f in have else other
    number = lambda f: F.coalesce(C(f), F.lit(0.0)) if f in have else F.lit(0.0)
    value = lambda f: F.lit("N/A") if f not in have else F.coalesce(C(f) if f == "recommendationKey" else plain(C(f)), F.lit("N/A"))
    lines = [
        F.concat(F.lit("COMPANY: "), text("longName", C("ticker"))), F.concat(F.lit("SECTOR: "), text("sector", F.lit("Unknown"))),
        F.concat(F.lit("INDUSTRY: "), text("industry", F.lit("Unknown"))), F.concat(F.lit("MARKET CAP: $"), fixed(number("marketCap"), 0, thousands=True)),
        F.concat(F.lit("52W RANGE: $"), fixed(number("fiftyTwoWeekLow"), 2), F.lit(" – $"), fixed(number("fiftyTwoWeekHigh"), 2)),
        F.concat(F.lit("EMPLOYEES: "), text("fullTimeEmployees", F.lit(None)).cast("string") if "fullTimeEmployees" in have else F.lit("N/A")),
        F.concat(F.lit("DESCRIPTION: "), F.coalesce(truncate_text(C("longBusinessSummary"), 600), F.lit("")) if "longBusinessSummary" in have else F.lit("")),
        *[F.concat(F.lit(f"{label}: {'$' if f == 'targetMeanPrice' else ''}"), value(f)) for label, f in PLAIN_LINES]]
    lines[5] = F.coalesce(lines[5], F.lit("EMPLOYEES: N/A"))
    return info.select("ticker", F.concat_ws("\n", *lines).alias("profile"))


def trend_lines(newest: DataFrame) -> DataFrame:
    """Price with the day's change, averages, oscillators and the trend of each newest bar; a missing number prints as zero."""
    v = lambda c, n: fixed(F.coalesce(C(c), F.lit(0.0)), n)
    change = F.when(C("previous") != 0, (C("close") - C("previous")) / C("previous") * 100)
    trend = F.when(F.coalesce("sma_50", F.lit(0.0)) > F.coalesce("sma_200", F.lit(0.0)), "GOLDEN CROSS (bullish)").otherwise("DEATH CROSS (bearish)")
    lines = [F.concat(F.lit("CURRENT PRICE: $"), v("close", 2), F.lit(" (today "), fixed(F.coalesce(change, F.lit(0.0)), 2, plus=True), F.lit("%)")),
             F.concat(F.lit("SMA 50: $"), v("sma_50", 2), F.lit(" SMA 200: $"), v("sma_200", 2)),
             F.concat(F.lit("RSI: "), v("rsi", 1), F.lit(" Stochastic %K: "), v("stoch_k", 1)), F.concat(F.lit("ATR: "), v("atr", 2)), F.concat(F.lit("Trend: "), trend)]
    return newest.select("ticker", F.concat_ws("\n", *lines).alias("trend"))


def briefing(tickers: DataFrame, profile: DataFrame, scored: DataFrame, importance: DataFrame, returns: DataFrame, risk: DataFrame,
             trend: DataFrame, digest: DataFrame) -> DataFrame:
    """(ticker, briefing): all blocks of each of ``tickers``, by equi-joins of tables with one row a ticker at most.

    A ticker without a score reads 'N/A' there, risk numbers that are missing print as zero, other missing blocks are
    empty but for their heading.
    """
    d = tickers.select("ticker")
    for part in (profile, scored.select("ticker", "direction", "confidence"), importance, returns, risk, trend, digest):
        d = d.join(part, "ticker", "left")
    zero = lambda c, n: fixed(F.coalesce(C(c), F.lit(0.0)), n)
    block = lambda c: F.coalesce(C(c), F.lit(""))
    lines = [
        F.concat(F.lit("TICKER: "), C("ticker")), block("profile"),
        F.concat(F.lit("PREDICTION: "), F.coalesce(C("direction"), F.lit("N/A"))),
        F.concat(F.lit("CONFIDENCE: "), F.coalesce(F.concat(fixed("confidence", 1), F.lit("%")), F.lit("N/A"))),
        F.lit("INDICATOR IMPORTANCE & VALUES:"), block("importance_text"), F.lit("HISTORICAL RETURNS:"), block("returns_text"), F.lit("RISK METRICS:"),
        F.concat(F.lit("Annualised Return: "), zero("annual_return", 1), F.lit("%")), F.concat(F.lit("Annualised Volatility: "), zero("annual_volatility", 1), F.lit("%")),
        F.concat(F.lit("Sharpe Ratio: "), zero("sharpe", 2)), F.concat(F.lit("Sortino Ratio: "), zero("sortino", 2)),
        F.concat(F.lit("Max Drawdown: "), zero("max_drawdown", 1), F.lit("%")), F.concat(F.lit("Positive Days: "), zero("positive_days", 1), F.lit("%")),
        F.lit("TREND SIGNALS:"), block("trend"), F.lit("RECENT NEWS:"), block("digest")]
    return d.select("ticker", F.concat_ws("\n", *lines).alias("briefing"))


def freshness(entries: DataFrame, now) -> DataFrame:
    """What the header and the model card say of each run-log entry: the date, the time in UTC, its age and band, and the
    accuracy in both forms. Without a time the date is a dash, the age unknown and the band that of 999 days."""
    from pricelens.functions.scalar import age_text
    from pricelens.operators.signals import staleness
    ts, acc = C("retrained_at"), C("accuracy")
    days = F.coalesce(F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts.cast("timestamp"))) / 86400), F.lit(999))
    return entries.select(
        *entries.columns, F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("\u2014")).alias("date_text"),
        F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC")), F.lit("unknown")).alias("time_text"),
        age_text(ts.cast("timestamp"), now).alias("age"), staleness(days).alias("band"),
        F.coalesce(F.concat(fixed(acc * 100, 1), F.lit("% acc")), F.lit("accuracy n/a")).alias("short_accuracy"),
        F.coalesce(F.concat(fixed(acc * 100, 2), F.lit("%")), F.lit("n/a")).alias("accuracy_text"))
