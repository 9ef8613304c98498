"""Driver contract: entry smoke, registry consistency, oracle agreement on a sample."""

import duckdb
import pytest

import __spark_entry__ as E
from frames import SF001
from pricelens.plans import catalog
from pricelens.plans.check import TABLES, compare


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"ticker", "rsi", "rsi_band", "trend"} <= set(df.columns)


def test_oracle_keys_subset():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 50


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


SAMPLE = ["bars_daily", "indicators_full", "signal_board", "period_returns", "risk_metrics",
          "embargo_split", "roc_auc", "class_report", "resolve_alias", "report_lines",
          "news_digest", "log_retention", "returns_text", "split_global", "resolve_search", "rows_map",
          "ticker_lists", "log_fallback", "profile_format"]


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, duck, name):
    s = E.queries()[name](spark, SF001).toPandas()
    d = duck.sql(E.oracle_sql()[name]).df()
    assert compare(s, d) is None


MODEL_QUERIES = {"boost_fit", "boost_importance", "model_roundtrip", "score_latest",
                 "importance_text", "train_run", "briefing_text", "analyse_queries"}
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"]


def test_plans_have_no_pairs_or_python(spark):
    """No query over the price tables plans a cartesian product, a nested-loop join or a Python UDF."""
    bad = {}
    for name, fn in catalog.QUERIES.items():
        if name in MODEL_QUERIES:
            continue
        plan = fn(spark, SF001)._jdf.queryExecution().executedPlan().toString()
        hits = [f for f in FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


@pytest.mark.parametrize("name", ["briefing_text", "analyse_queries", "model_roundtrip", "importance_text"])
def test_model_queries_build_the_bars_once(spark, monkeypatch, name):
    """The ticks are read by one job that stores the bars; every part of the query reads the stored ones."""
    built, bars = [], catalog.D.bars
    monkeypatch.setattr(catalog.D, "bars", lambda *a: built.append(a) or bars(*a))
    monkeypatch.setattr(catalog, "MODEL_ROUNDS", 2)
    monkeypatch.setattr(catalog.fitted_model, "__defaults__", (2, None))
    df = catalog.QUERIES[name](spark, SF001)
    assert len(built) == 1
    assert "l_shipdate" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() > 0
