"""Inputs of the reference re-derived from the shared test tables (see FIXTURES.md).

Each builder reads the parquet tables it needs (column-pruned at the scan) and
returns a DataFrame; the SQL twins used by the oracle live in ``plans.sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.sources.bars import bars_from_ticks, lineitem_bars
from pricelens.sources.tables import read_table

C = F.col


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, ticker = supplier nation, sector = region."""
    return lineitem_bars(spark, sf_dir, "nation")


def bars_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Denser daily bars, one series per region."""
    return lineitem_bars(spark, sf_dir, "region")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the events table: ticker = event_type, price = value,
    tick order = (ts, event_id). Batch twin of the streaming bar builder."""
    ev = event_ticks(spark, sf_dir).withColumns({
        "ticker": C("event_type"), "one": F.lit(1.0),
        "hour": F.date_trunc("hour", "ts").cast("timestamp_ntz")})
    return bars_from_ticks(ev, ["ticker"], "hour", "value", "one", ["ts", "event_id"])


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector -> ticker dimension (nation x region; 25 rows at every scale)."""
    nat = read_table(spark, sf_dir, "nation", "n_name", "n_regionkey")
    reg = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    return (nat.join(F.broadcast(reg), nat.n_regionkey == reg.r_regionkey)
               .select(C("r_name").alias("sector"), C("n_name").alias("ticker")))


def universe_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Universe in its dict-of-lists form: one row, map<sector, array<ticker>>."""
    u = universe(spark, sf_dir)
    per = u.groupBy("sector").agg(F.sort_array(F.collect_list("ticker")).alias("tickers"))
    return per.agg(F.map_from_entries(F.collect_list(F.struct("sector", "tickers")))
                   .alias("universe"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company snapshot per ticker from supplier and customer balances.

    market_cap = sum(c_acctbal) * 1e6, trailing_pe = avg(s_acctbal) / 100,
    revenue_growth = avg(c_acctbal) / avg(s_acctbal) - 1,
    profit_margin = suppliers / customers; missing parts stay null.
    """
    nat = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    reg = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    s = (read_table(spark, sf_dir, "supplier", "s_nationkey", "s_acctbal")
         .groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("avg_s"),
                                     F.count("*").alias("n_s")))
    c = (read_table(spark, sf_dir, "customer", "c_nationkey", "c_acctbal")
         .groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("sum_c"),
                                     F.avg("c_acctbal").alias("avg_c"),
                                     F.count("*").alias("n_c")))
    j = (nat.join(F.broadcast(reg), nat.n_regionkey == reg.r_regionkey)
            .join(s, nat.n_nationkey == s.s_nationkey, "left")
            .join(c, nat.n_nationkey == c.c_nationkey, "left"))
    return j.select(
        C("n_name").alias("ticker"),
        F.initcap(F.replace(C("n_name"), F.lit("_"), F.lit(" "))).alias("long_name"),
        C("r_name").alias("sector"),
        (C("sum_c") * 1e6).alias("market_cap"),
        (C("avg_s") / 100).alias("trailing_pe"),
        (F.try_divide(C("avg_c"), C("avg_s")) - 1).alias("revenue_growth"),
        F.try_divide(C("n_s").cast("double"), C("n_c").cast("double")).alias("profit_margin"),
    )


def profile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON profile documents: the events.props strings."""
    return read_table(spark, sf_dir, "events", "event_id", "event_type", "props")


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name dictionary: lower(name) -> ticker, plus the name with '_' read as a space."""
    nat = read_table(spark, sf_dir, "nation", "n_name")
    a = nat.select(F.lower("n_name").alias("alias"), C("n_name").alias("ticker"))
    b = nat.select(F.replace(F.lower("n_name"), F.lit("_"), F.lit(" ")).alias("alias"),
                   C("n_name").alias("ticker"))
    return a.unionByName(b).distinct()


# Suffixes appended to build user search strings, chosen by n_nationkey % 6 (fixed values).
QUERY_SUFFIXES = [" inc.", " corp", " group", " ltd", "", " widgets"]


def alias_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    nat = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    suf = F.element_at(F.array(*[F.lit(s) for s in QUERY_SUFFIXES]),
                       (F.pmod(C("n_nationkey"), F.lit(6)) + 1).cast("int"))
    name = F.when(F.pmod(C("n_nationkey"), F.lit(2)) == 0, F.replace(C("n_name"), F.lit("_"), F.lit(" "))) \
        .otherwise(C("n_name"))
    return nat.select(C("n_nationkey").alias("query_id"),
                      F.concat(F.lit("  "), name, suf).alias("query"))


# Quote type by the first word of p_type (fixed values of this fixture).
QUOTE_KINDS = {"ECONOMY": "ETF", "PROMO": "MUTUALFUND", "SMALL": "INDEX"}  # others: EQUITY


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search universe: one quote per part, symbol 'P<partkey>', name p_name, quote type
    from the first word of p_type."""
    pt = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    w = F.split(C("p_type"), " ").getItem(0)
    kind = F.lit("EQUITY")
    for k, v in reversed(list(QUOTE_KINDS.items())):
        kind = F.when(w == k, v).otherwise(kind)
    return pt.select(F.concat(F.lit("P"), C("p_partkey").cast("string")).alias("symbol"),
                     C("p_name").alias("name"), kind.alias("kind"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search string per part, by p_partkey % 4: a prefix of the name (padded), the
    first word upper-cased, a symbol prefix 'p<partkey div 7>', or the name plus a word."""
    pt = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    k = C("p_partkey")
    n = F.greatest(F.length("p_name"), F.lit(1)).cast("long")
    q = (F.when(F.pmod(k, F.lit(4)) == 0,
                F.concat(F.lit("  "), F.left(C("p_name"), (F.lit(1) + F.pmod(k, n)).cast("int"))))
         .when(F.pmod(k, F.lit(4)) == 1, F.upper(F.split(C("p_name"), " ").getItem(0)))
         .when(F.pmod(k, F.lit(4)) == 2, F.concat(F.lit("p"), F.expr("p_partkey div 7").cast("string")))
         .otherwise(F.concat(C("p_name"), F.lit(" widgets"))))
    return pt.select(k.alias("query_id"), q.alias("query"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items: ticker = conv_id, position = turn, publisher = role,
    summary = text, title = the text's first line."""
    cv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return cv.select(C("conv_id").alias("ticker"), C("turn").alias("position"),
                     F.split_part(C("text"), F.lit("\n"), F.lit(1)).alias("title"),
                     C("role").alias("publisher"), C("text").alias("summary"))


def news_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items in the provider's nested shape (content.provider.displayName, ...)."""
    n = news(spark, sf_dir)
    return n.select("ticker", "position", F.struct(F.struct(
        C("title").alias("title"), C("summary").alias("summary"),
        F.lit(None).cast("string").alias("pubDate"),
        F.struct(C("publisher").alias("displayName")).alias("provider"),
        F.lit(None).cast("struct<url:string>").alias("canonicalUrl"),
    ).alias("content")).alias("item"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id", "text")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrain-log stand-in: one entry per (l_returnflag, ship month) with counts
    and ratios as metrics; the month start is the ``retrained_at`` time."""
    li = read_table(spark, sf_dir, "lineitem", "l_returnflag", "l_shipdate", "l_discount",
                    "l_quantity")
    g = li.groupBy(C("l_returnflag").alias("period"),
                   F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("retrained_at"))
    return g.agg(F.count("*").alias("total_rows"),
                 F.avg((C("l_discount") > 0.05).cast("double")).alias("accuracy"),
                 F.avg((C("l_quantity") > 25).cast("double")).alias("baseline_always_up_acc"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated company figures: the orders of a nation's customers by month, published when the month is over."""
    od = read_table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    cu = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    nat = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    g = od.join(cu, od.o_custkey == cu.c_custkey).groupBy("c_nationkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(
        F.sum("o_totalprice").alias("revenue"), F.count("*").alias("n_orders"))
    return g.join(F.broadcast(nat), g.c_nationkey == nat.n_nationkey).select(
        C("n_name").alias("ticker"), (C("month") + F.expr("INTERVAL 1 MONTH")).alias("as_of"), "revenue", "n_orders")


def misspelt_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search string per part with mistakes, by p_partkey % 5: the name without its third letter, the name's words
    turned round, its last word with two letters swapped, an unknown word, or the name as it is."""
    pt = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    k, n = F.pmod(C("p_partkey"), F.lit(5)), C("p_name")
    last = F.element_at(F.split(n, " "), -1)
    swapped = F.concat(F.substring(last, 1, 1), F.substring(last, 3, 1), F.substring(last, 2, 1), F.expr("substring(element_at(split(p_name, ' '), -1), 4)"))
    q = (F.when(k == 0, F.concat(F.substring(n, 1, 2), F.expr("substring(p_name, 4)")))
         .when(k == 1, F.array_join(F.reverse(F.split(n, " ")), " ")).when(k == 2, swapped)
         .when(k == 3, F.concat(n, F.lit(" zzzzzz"))).otherwise(n))
    return pt.select(C("p_partkey").alias("query_id"), q.alias("query"))


# Number fields of the company table, in the order in which they draw from the supplier's balance (fixed values of this fixture).
INFO_NUMBERS = ["trailingPE", "forwardPE", "pegRatio", "priceToBook", "priceToSalesTrailing12Months", "enterpriseToEbitda", "fiftyTwoWeekHigh", "fiftyTwoWeekLow",
                "revenueGrowth", "earningsGrowth", "trailingEps", "profitMargins", "operatingMargins", "grossMargins", "returnOnEquity", "returnOnAssets", "debtToEquity",
                "currentRatio", "quickRatio", "totalCash", "totalDebt", "dividendYield", "payoutRatio", "beta", "targetMeanPrice", "targetLowPrice", "targetHighPrice", "marketCap"]


def company_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company per supplier with every field of the profile; by (3 * key + field) % 6 a number is missing, zero, small,
    negative, in the thousands or in the millions, and texts are missing, empty or long."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal")
    k, v = C("s_suppkey"), C("s_acctbal")

    def number(i):
        m = F.pmod(k * 3 + i, F.lit(6))
        return F.when(m == 1, F.lit(0.0)).when(m == 2, v / 1e7).when(m == 3, v / -1000).when(m == 4, v * i).when(m == 5, v * 1e6)

    word = F.element_at(F.array(F.lit("buy"), F.lit("hold"), F.lit(None), F.lit("")), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    return s.select(C("s_name").alias("ticker"), F.when(F.pmod(k, F.lit(5)) > 0, F.concat(C("s_name"), F.lit(" Ltd"))).alias("longName"),
                    F.when(F.pmod(k, F.lit(4)) > 0, F.concat(F.lit("Industry "), F.pmod(k, F.lit(4)))).alias("industry"), word.alias("recommendationKey"),
                    F.when(F.pmod(k, F.lit(3)) > 0, k * 37).alias("fullTimeEmployees"), F.when(F.pmod(k, F.lit(3)) < 2, k).alias("numberOfAnalystOpinions"),
                    F.when(F.pmod(k, F.lit(6)) > 0, F.repeat(F.concat(C("s_name"), F.lit(" é ")), (F.pmod(k, F.lit(50)) + 1).cast("int"))).alias("longBusinessSummary"),
                    *[number(i).alias(f) for i, f in enumerate(INFO_NUMBERS)])


def board_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of display numbers per order, by remainders of its key: each is missing for some, lies on every bound for others,
    and falls into every band."""
    k = C("o_orderkey")
    part = lambda by, n, low=0, unit=1: ((F.pmod(k * by, F.lit(n)) + low) / unit).cast("double")
    some = lambda c, n: F.when(F.pmod(k, F.lit(n)) > 0, c)
    return read_table(spark, sf_dir, "orders", "o_orderkey").select(
        k.alias("state_id"), some(part(7, 1001, 0, 10), 11).alias("rsi"), some(part(1, 5, -2), 13).alias("macd"), some(part(3, 131, -15, 100), 17).alias("bb_position"),
        some(part(1, 23, 0, 10), 19).alias("volume_ratio"), some(part(3, 7), 23).alias("sma_50"), some(part(5, 9), 29).alias("sma_200"), some(part(13, 101), 31).alias("stoch_k"),
        some(part(5, 41, -15, 10), 37).alias("sharpe"), some(part(11, 97, 0, 2), 41).alias("annual_volatility"), some(part(3, 113, -112, 2), 43).alias("max_drawdown"),
        some(part(7, 41, 90, 2), 47).alias("confidence"), part(1, 90).alias("age_days"), some(part(17, 301, 0) * 1e9, 53).alias("market_cap"))


def profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON text per supplier: fields are given, missing, null, of another type, or the text is no object at all."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    k = C("s_suppkey")
    m = lambda n: F.pmod(k, F.lit(n))
    cents = F.round(C("s_acctbal") * 100).cast("long").cast("string")
    item = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    body = F.concat(F.lit("{"), F.concat_ws(", ",
        F.when(m(5) > 0, item("longName", F.concat(F.lit('"'), C("s_name"), F.lit(' \\"Ltd\\""')))),
        F.when(m(4) == 1, item("sector", F.lit('"Energy"'))).when(m(4) == 2, item("sector", F.lit("null"))).when(m(4) == 3, item("sector", F.lit("7"))),
        F.when(m(3) > 0, item("industry", F.lit('"Oil & Gas"'))), F.when(m(7) > 2, item("recommendationKey", F.lit('"buy"'))),
        F.when(m(6) > 0, item("longBusinessSummary", F.concat(F.lit('"'), F.repeat(F.concat(C("s_name"), F.lit(" é ")), 40), F.lit('"')))),
        F.when(m(6) == 1, item("trailingPE", cents)).when(m(6) == 2, item("trailingPE", F.concat(F.lit('"'), cents, F.lit('"')))).when(m(6) == 3, item("trailingPE", F.lit("12.625")))
        .when(m(6) == 4, item("trailingPE", F.lit("null"))).when(m(6) == 5, item("trailingPE", F.lit("-2.5e-3"))),
        F.when(m(4) == 0, item("marketCap", F.concat(cents, F.lit("00000")))).when(m(4) == 1, item("marketCap", F.lit("true"))).when(m(4) == 2, item("marketCap", F.lit("0"))),
        F.when(m(3) == 0, item("revenueGrowth", F.lit("0.125"))).when(m(3) == 1, item("revenueGrowth", F.lit("[1]"))),
        F.when(m(2) == 0, item("profitMargins", F.lit("-0.5")))), F.lit("}"))
    props = F.when(m(31) == 1, "").when(m(31) == 2, '{"longName": "cut').when(m(31) == 3, "[1, 2]").when(m(31) == 4, "null").when(m(31) == 5, F.lit(None)).otherwise(body)
    return s.select(C("s_name").alias("ticker"), props.alias("props"))


def news_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The news items in the provider's nested shape with dates and links; by (ticker + position) % 8 one level or another is missing."""
    n = news(spark, sf_dir)
    m = F.pmod(C("ticker") + C("position"), F.lit(8))
    date = F.concat(F.lit("2024-0"), F.pmod(C("position"), F.lit(9)) + 1, F.lit("-1"), F.pmod(C("ticker"), F.lit(10)), F.lit("T08:30:00Z"))
    link = F.concat(F.lit("https://example.org/"), C("ticker"), F.lit("/"), C("position"))
    content = F.struct(
        F.when(m != 1, C("title")).alias("title"), F.when(m != 2, C("summary")).alias("summary"), F.when(m != 3, date).alias("pubDate"),
        F.when(m != 4, F.struct(F.when(m != 5, C("publisher")).alias("displayName"))).alias("provider"),
        F.when(m != 6, F.struct(F.when(m != 7, link).alias("url"))).alias("canonicalUrl"))
    return n.select("ticker", "position", F.struct(F.when(F.pmod(C("position"), F.lit(5)) != 4, content).alias("content")).alias("item"))


def nation_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company per nation: its supplier with the smallest key, under the nation's name; every fifth nation without a sector."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey").groupBy("s_nationkey").agg(F.min_by("s_name", "s_suppkey").alias("company"))
    reg = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    nat = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").join(F.broadcast(reg), C("n_regionkey") == C("r_regionkey"))
    first = s.join(F.broadcast(nat), C("s_nationkey") == C("n_nationkey"))
    sector = F.when(F.pmod(C("n_nationkey"), F.lit(5)) > 0, C("r_name"))
    info = company_info(spark, sf_dir).withColumnRenamed("ticker", "company")
    return first.select(C("n_name").alias("ticker"), sector.alias("sector"), "company").join(info, "company").drop("company")
