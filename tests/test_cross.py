"""As-of joins, folds, peers and ranks, the bar store and fuzzy search against literal tables and plain loops."""

import datetime as dt
import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from frames import SF001, to_spark, walk

import __spark_entry__ as E
from pricelens.operators import cross as X
from pricelens.operators import labels as L
from pricelens.operators import resolve as R
from pricelens.plans.check import TABLES, compare
from pricelens.sources import store
from pricelens.sources.bars import restrict_period


def day(n):
    return dt.datetime(2021, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["asof_profile", "walk_forward_folds", "sector_momentum", "cross_rank", "bars_landed", "resolve_literal",
                                  "resolve_fuzzy", "fixed_scores", "fixed_latest", "fixed_importance_text", "fixed_metrics",
                                  "fundamentals_cards", "company_profile", "trend_text"])
def test_oracle(spark, duck, name):
    assert compare(E.queries()[name](spark, SF001).toPandas(), duck.sql(E.oracle_sql()[name]).df()) is None


def test_literal_tickers_are_found(spark):
    assert E.queries()["resolve_literal"](spark, SF001).where("stage = 'literal'").count() >= 5


def test_asof_takes_the_newest_snapshot_that_is_out(spark):
    left = spark.createDataFrame([("a", day(0), 1), ("a", day(5), 2), ("a", day(5), 3), ("a", day(9), 4), ("b", day(9), 5), (None, day(9), 6)], "ticker string, ts timestamp_ntz, n int")
    right = spark.createDataFrame([("a", day(5), 10.0), ("a", day(7), None), ("a", day(7), None), ("c", day(0), 1.0), (None, day(0), 2.0), ("b", None, 3.0)], "ticker string, as_of timestamp_ntz, v double")
    got = {r.n: (r.as_of, r.v) for r in X.asof_join(left, right, ["v"]).collect()}
    assert got == {1: (None, None), 2: (day(5), 10.0), 3: (day(5), 10.0), 4: (day(7), None), 5: (None, None), 6: (None, None)}
    assert X.asof_join(left, right.where("false"), ["v"]).where("v is not null").count() == 0


def test_walk_forward_purges_labels_that_reach_the_test_part(spark):
    rows = [(t, day(k), k) for t in "ab" for k in range(12)]
    d = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, k int")
    got = {(r.ticker, r.k, r.fold): r.part for r in X.walk_forward(d, folds=2, horizon=2).collect()}
    want = {}
    for t, k, (fold, start, stop) in itertools.product("ab", range(12), [(1, 4, 7), (2, 8, 11)]):
        if k <= stop:
            want[t, k, fold] = "test" if k >= start else "train" if k + 2 < start else "purged"
    assert got == want


def test_peers_leave_the_own_value_out(spark):
    d = spark.createDataFrame([("a", "s", 1, 1.0), ("b", "s", 1, 3.0), ("c", "s", 1, 8.0), ("d", "s", 1, None), ("e", "t", 1, 2.0), ("a", "s", 2, 5.0)], "ticker string, sector string, ts int, v double")
    got = {(r.ticker, r.ts): (r.peers, r.relative) for r in X.sector_relative(d, "v").collect()}
    assert got == {("a", 1): (5.5, -4.5), ("b", 1): (4.5, -1.5), ("c", 1): (2.0, 6.0), ("d", 1): (None, None), ("e", 1): (None, None), ("a", 2): (None, None)}


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_ranks_with_ties_in_any_number_of_ranges(spark, parts):
    rng = random.Random(parts)
    rows = [(k % 4, rng.choice([None, 0.5, 1.0, 2.0, rng.random()])) for k in range(300)] + [(9, 1.0), (8, None)]
    got = sorted(((r.ts, r.v, r.rank, r.n, r.pct_rank) for r in X.cross_rank(spark.createDataFrame(rows, "ts int, v double"), "v", parts=parts).collect()), key=str)
    want = []
    for t, v in rows:
        of = [x for s, x in rows if s == t and x is not None]
        rank = None if v is None else 1 + sum(x < v for x in of)
        want.append((t, v, rank, None if v is None else len(of), None if v is None else (rank - 1) / (len(of) - 1) if len(of) > 1 else 0.0))
    assert got == sorted(want, key=str)


def test_store_replaces_months_and_reads_few(spark, tmpdir_path):
    bars = to_spark(spark, walk("a", 120)).unionByName(to_spark(spark, walk("b", 60, 1)))
    store.land_bars(bars, tmpdir_path)
    store.land_bars(bars.where("ts >= '2020-03-01' and ts < '2020-04-01'").selectExpr("ticker", "sector", "ts", "open", "high", "low", "close", "7.0 as volume"), tmpdir_path)
    got = store.read_store(spark, tmpdir_path)
    assert got.count() == 180 and got.where("volume = 7").count() == 31
    part = store.read_store(spark, tmpdir_path, dt.datetime(2020, 2, 10), dt.datetime(2020, 3, 5))
    assert part.count() == 24 + 20
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(ts)" in plan
    assert {r.ticker: (r.ts, r.n_rows) for r in store.recent(spark, tmpdir_path).collect()} == {"a": (dt.datetime(2020, 4, 29), 120), "b": (dt.datetime(2020, 2, 29), 60)}


def test_retrain_reads_landed_bars(spark, tmpdir_path):
    from pricelens.plans import retrain
    bars = to_spark(spark, walk("a", 700)).unionByName(to_spark(spark, walk("b", 600, 1)))
    store.land_bars(bars, tmpdir_path)
    _, rec = retrain.run(spark, bars_path=f"{tmpdir_path}/bars", rounds=2, out=f"{tmpdir_path}/out")
    assert rec.first().total_rows == 1300


def test_history_is_counted_inside_the_period(spark):
    """A ticker with 200 bars, 150 of them in the period, isn't trained on."""
    old = walk("a", 200)
    old.loc[:49, "ts"] = [dt.datetime(2001, 1, 1) + dt.timedelta(days=k) for k in range(50)]
    assert L.min_history(restrict_period(to_spark(spark, old), 10), 200).count() == 0
    assert L.min_history(to_spark(spark, old), 200).count() == 200


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_near_words_are_all_within_the_distance(spark):
    rng = random.Random(3)
    some = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(150)})
    q = spark.createDataFrame([(w,) for w in some], "q string")
    got = {(r.q, r.w): r.d for r in R.near_words(q, q.withColumnRenamed("q", "w")).collect()}
    edits = lambda w: 2 if len(w) >= 6 else 1 if len(w) >= 3 else 0
    assert got == {(a, b): distance(a, b) for a in some for b in some if distance(a, b) <= edits(a)}


def test_fuzzy_finds_misspelt_and_turned_names(spark):
    quotes = spark.createDataFrame([("x1", "Big Orange Company", "EQUITY"), ("x2", "Orange", "INDEX"), ("x3", "Grange Farms", "ETF"), ("x4", None, "ETF")], "symbol string, name string, kind string")
    asked = ["orange", "compny big", "ornage", "grange farm", "apple", "", None, "big apple"]
    d = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = {r.query_id: (r.ticker, r.score) for r in R.resolve_fuzzy(d, quotes).collect()}
    assert got == {0: ("X1", 2), 1: ("X1", 11), 2: ("X1", 22), 3: ("X3", 10), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None)}


def test_names_of_the_same_words_are_met_once(spark):
    """However many names have the same words, a query meets one row for them, and the first symbols still win."""
    rows = [(f"s{i:03d}", name, "INDEX" if i < 2 else "EQUITY") for i in range(200) for name in ("Big Ring", "ring BIG ring")]
    quotes = spark.createDataFrame(rows + [("a1", "big ring small", "ETF"), ("a2", None, "ETF")], "symbol string, name string, kind string")
    sets = {tuple(r.words): sorted(x.symbol for x in r.top) for r in R.word_sets(quotes).collect()}
    assert sets == {("big", "ring"): ["s000", "s001", "s002"], ("big", "ring", "small"): ["a1"]}
    asked = spark.createDataFrame(list(enumerate(["ring big", "bigg ring", "rinng smal"])), "query_id int, query string")
    assert {r.query_id: (r.ticker, r.score) for r in R.resolve_fuzzy(asked, quotes).collect()} == {0: ("S002", 0), 1: ("S002", 10), 2: ("A1", 21)}


def test_plain_numbers(spark):
    """Usual numbers as Python prints them; any number reads back as itself (Java may print a digit more)."""
    from pricelens.operators.report import plain
    rng = random.Random(1)
    usual = [0.0, -0.0, 1.0, 0.1, 1e-4, 9.9e-5, 7.3e-6, 1e7, 12345678.9, 1e15, 1e16, -2.5e20, 1e100]
    values = usual + [rng.uniform(-1, 1) * 10**rng.randint(-12, 18) for _ in range(300)]
    got = [(r.x, r.s) for r in spark.createDataFrame([(v,) for v in values], "x double").select("x", plain(F.col("x")).alias("s")).collect()]
    assert [s for _, s in got[:len(usual)]] == [repr(v) for v in usual]
    assert all(float(s) == x and "E" not in s for x, s in got)
