"""Scalar helpers, text operators and the resolver."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricelens.functions.scalar import age_text, fixed, sanitize
from pricelens.operators import report as P
from pricelens.operators.resolve import resolve


def test_sanitize_bad_numbers(spark):
    vals = [None, "NaN", "Infinity", "-Infinity", "N/A", "", "0.025", "2.5", "0"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(sanitize(F.col("v"))).collect()]
    assert got == [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.025, 2.5, 0.0]


def test_pct_smart(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 0.025, 2.5, -0.5, None]], "v double")
    got = [r[0] for r in df.select(P.fmt_pct_smart(F.col("v"))).collect()]
    assert got == ["0.0%", "2.50%", "2.50%", "-50.00%", "N/A"]


def test_fixed_rounds_the_exact_value(spark):
    """Ties by the exact binary value, half to even; literal expectations, then C's own formatter."""
    ties = [(2.675, "2.67"), (0.125, "0.12"), (0.375, "0.38"), (1.005, "1.00"), (-0.125, "-0.12"), (0.0, "0.00"), (1234567.895, "1234567.90"), (99.995, "100.00")]
    df = spark.createDataFrame([(v,) for v, _ in ties], "v double")
    assert [r[0] for r in df.select(fixed("v", 2)).collect()] == [t for _, t in ties]
    one = spark.createDataFrame([(0.25,), (0.35,), (-0.04,), (12345.65,)], "v double")
    assert [r[0] for r in one.select(fixed("v", 1, plus=True)).collect()] == ["+0.2", "+0.3", "-0.0", "+12345.6"]
    assert [r[0] for r in one.select(fixed("v", 0, thousands=True)).collect()] == ["0", "0", "-0", "12,346"]
    import random
    rng = random.Random(8)
    values = [rng.choice([rng.uniform(-1e6, 1e6), rng.randrange(-10**7, 10**7) / 1000, rng.randrange(-10**5, 10**5) / 8]) for _ in range(3000)]
    many = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for n in (0, 1, 2, 4):
        got = {r[0]: r[1] for r in many.select("i", fixed("v", n)).collect()}
        assert got == {i: "%.*f" % (n, v) for i, v in enumerate(values)}


AGES = [(0, "just now"), (59, "just now"), (60, "1 min ago"), (3599, "59 min ago"), (3600, "1 hr ago"),
        (86399, "23 hr ago"), (86400, "1 day ago"), (172800, "2 days ago"), (604800, "1 week ago"),
        (34 * 86400, "4 weeks ago"), (35 * 86400, "1 month ago"), (75 * 86400, "2 months ago"),
        (359 * 86400, "11 months ago"), (365 * 86400, "1 year ago"), (800 * 86400, "2 years ago")]


def test_age_text(spark):
    now = dt.datetime(2026, 6, 1, 12, 0, 0)
    rows = [(now - dt.timedelta(seconds=s), now) for s, _ in AGES]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, now timestamp_ntz")
    assert [r[0] for r in df.select(age_text(F.col("ts"), F.col("now"))).collect()] == [t for _, t in AGES]


def test_report_lines(spark):
    text = ("### Verdict\r\n  - point one\t\nplain para\n\n   \n ### not heading?\n"
            "-nobullet\n\x1c- sep bullet　\n### \n")
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r["line_no"], r["kind"], r["content"]) for r in
           P.report_lines(df).orderBy("line_no").collect()]
    assert got == [(0, "heading", "Verdict"), (1, "bullet", "point one"), (2, "paragraph", "plain para"),
                   (5, "heading", "not heading?"), (6, "paragraph", "-nobullet"), (7, "bullet", "sep bullet"),
                   (8, "paragraph", "###")]


def test_news_digest(spark):
    rows = [(1, i, {"content": {"title": ("" if i == 2 else f"t{i}"), "summary": "x" * 200,
                                "pubDate": None, "provider": {"displayName": "P"},
                                "canonicalUrl": None}}) for i in range(12)]
    from pricelens.schema import NEWS_ITEM
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("ticker", T.LongType()),
                           T.StructField("position", T.LongType()),
                           T.StructField("item", NEWS_ITEM)])
    flat = P.news_flatten(spark.createDataFrame(rows, schema), 10)
    assert flat.count() == 10
    dg = P.news_digest(flat).first()["digest"].split("\n")
    assert len(dg) == 5  # first 6 items, one without title
    assert dg[0] == "- [P] t0: " + "x" * 160


def test_resolver_stages(spark):
    aliases = spark.createDataFrame([("apple", "AAPL"), ("general motors", "GM")], "alias string, ticker string")
    bars = spark.createDataFrame([("MSFT", dt.datetime(2024, 1, 5)), ("AAPL", dt.datetime(2024, 1, 5)),
                                  ("OLD", dt.datetime(2023, 1, 1))], "ticker string, ts timestamp_ntz")
    q = spark.createDataFrame([(1, " Apple "), (2, "apple inc."), (3, "General Motors Corp"),
                               (4, "msft"), (5, "old"), (6, "nothing here"), (7, "apple co")],
                              "query_id long, query string")
    got = {r["query_id"]: (r["ticker"], r["stage"]) for r in resolve(q, aliases, bars).collect()}
    assert got[1] == ("AAPL", "alias")
    assert got[2] == ("AAPL", "suffix")
    assert got[3] == ("GM", "suffix")
    assert got[4] == ("MSFT", "literal")
    assert got[5] == (None, None)
    assert got[6] == (None, None)
    assert got[7] == ("AAPL", "suffix")
    twice = resolve(q.union(q), aliases, bars).groupBy("query_id").count().collect()
    assert {r["count"] for r in twice} == {2}  # a repeated id multiplies nothing


def _brute_search(quotes, queries, k=3, accepted=("EQUITY", "ETF")):
    out = {}
    for qid, query in queries:
        q = query.strip().lower()
        hits = []
        for sym, name, kind in quotes:
            keys = [x for x in (name.strip().lower(), sym.lower()) if q and x.startswith(q)]
            if keys:
                hits.append((min(len(x) for x in keys) - len(q), sym, kind))
        hits.sort()
        pick = next((s.upper() for _, s, kd in hits[:k] if kd in accepted), None)
        out[qid] = pick
    return out


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_search_stage_matches_brute_force(spark, threshold):
    """With broadcast joins and without, the prefix table agrees with brute force."""
    from pricelens.operators.resolve import search_hits, search_pick
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    quotes = [("P1", "red widget", "EQUITY"), ("P2", "red bolt", "MUTUALFUND"),
              ("P3", "red", "INDEX"), ("P4", "reddish gear", "INDEX"),
              ("P5", "red widgets", "ETF"), ("PR", "print", "EQUITY"),
              ("P10", "p10 holdings", "EQUITY"), ("X", "", "EQUITY")]
    quotes += [(f"S{i}", f"same name {i % 7}", "EQUITY" if i % 3 else "INDEX") for i in range(60)]
    queries = [(1, "red"), (2, " RED B"), (3, "re"), (4, "p1"), (5, "pr"), (6, "x"),
               (7, ""), (8, "   "), (9, "same"), (10, "same name 3"), (11, "zzz"),
               (12, "p10 h"), (13, "red widgets!"), (14, "s1")]
    qdf = spark.createDataFrame(queries, "query_id long, query string") \
        .withColumn("q", F.lower(F.trim("query")))
    qt = spark.createDataFrame(quotes, "symbol string, name string, kind string")
    pick = search_pick(search_hits(qt, qdf.select("q")))
    got = {r["query_id"]: r["symbol"] for r in
           qdf.join(pick, qdf["q"] == pick["p"], "left").select("query_id", "symbol").collect()}
    assert got == _brute_search(quotes, queries)
    # the 4th hit of "red" is acceptable (P5) but outside the top 3 -> P1 wins
    assert got[1] == "P1" and got[7] is None and got[8] is None
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_search_stage_property(spark):
    """Random quote tables and queries over a tiny alphabet (many shared prefixes and
    ties): the prefix-table search equals the brute-force definition."""
    from hypothesis import given, settings, HealthCheck
    from hypothesis import strategies as st
    from pricelens.operators.resolve import search_hits, search_pick

    word = st.text(alphabet="abA ", min_size=0, max_size=6)
    quote = st.tuples(st.text(alphabet="ab", min_size=1, max_size=3), word,
                      st.sampled_from(["EQUITY", "ETF", "INDEX", "MUTUALFUND"]))

    @settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(quote, min_size=1, max_size=25, unique_by=lambda q: q[0]),
           st.lists(word, min_size=1, max_size=12))
    def check(quotes, qs):
        queries = list(enumerate(qs))
        qdf = spark.createDataFrame(queries, "query_id long, query string") \
            .withColumn("q", F.lower(F.trim("query")))
        qt = spark.createDataFrame(quotes, "symbol string, name string, kind string")
        pick = search_pick(search_hits(qt, qdf.select("q")))
        got = {r["query_id"]: r["symbol"] for r in
               qdf.join(pick, qdf["q"] == pick["p"], "left").select("query_id", "symbol").collect()}
        assert got == _brute_search(quotes, queries)

    check()
