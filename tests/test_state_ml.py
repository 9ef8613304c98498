"""Indicator state against the indicators over whole histories, and SAMME as a pipeline stage."""

import datetime as dt
import os

import duckdb
import pytest
from frames import SF001, to_spark, walk
from pyspark.sql import functions as F

import __spark_entry__ as E
from pricelens.functions.scalar import sanitize
from pricelens.operators import indicators as I
from pricelens.operators.summary import with_extent
from pricelens.plans.check import TABLES, compare
from pricelens.plans.more import fixed_model
from pricelens.schema import FEATURES_7
from pricelens.streaming import state as ST

NAMES = [*FEATURES_7, "sma_50", "sma_200", "drawdown"]


def newest(bars):
    d = with_extent(I.drawdown(I.indicators_core(bars))).where("rpos = 0")
    return {r.ticker: [r.ts, *[r[c] for c in NAMES]] for r in d.collect()}


def close_to(a, b):
    return all(x == y or x is not None and y is not None and not isinstance(x, dt.datetime) and abs(x - y) < 1e-8 * max(1, abs(y)) for x, y in zip(a, b, strict=True))


def test_oracle(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    assert compare(E.queries()["state_features"](spark, SF001).toPandas(), con.sql(E.oracle_sql()["state_features"]).df()) is None


@pytest.mark.parametrize("cuts", [[400], [1, 2, 13, 14, 15, 20, 31, 60, 400], [150, 350, 400]])
def test_state_equals_the_whole_history(spark, cuts):
    """Whatever the batches: short histories, gaps in the closes, tickers that come later, bars that come again or late."""
    holes = walk("gaps", 330, 5)
    holes.loc[[4, 100, 250, 318], "close"] = None
    flat = walk("flat", 40, 6)
    flat["close"] = 5.0
    bars = to_spark(spark, walk("a", 400)).unionByName(to_spark(spark, holes)).unionByName(to_spark(spark, walk("few", 9, 2))).unionByName(to_spark(spark, flat))
    bars = bars.checkpoint()
    state, start = ST.empty_state(spark), 0
    day = lambda k: F.lit(dt.datetime(2020, 1, 1) + dt.timedelta(days=k)).cast("timestamp_ntz")
    for epoch, cut in enumerate(cuts):
        batch = bars.where((F.col("ts") >= day(max(0, start - 3))) & (F.col("ts") < day(cut)))  # three days again
        state, start = ST.advance(state, batch, epoch).checkpoint(), cut
    got = {r.ticker: [r.ts, *[r[c] for c in NAMES]] for r in ST.features(state).collect()}
    want = newest(bars)
    assert got.keys() == want.keys() and all(close_to(got[t], want[t]) for t in got), (got, want)
    odd = state.limit(0).unionByName(state)
    none = ST.advance(odd, bars.where("false"), 99)
    assert none.where("epoch = 99").count() == 0 and none.count() == state.count()


def test_stream_scores_from_state_and_survives_a_replay(spark, tmpdir_path):
    bars = to_spark(spark, walk("a", 300)).unionByName(to_spark(spark, walk("b", 290, 1))).select("ticker", "ts", "close", "volume").checkpoint()
    model, seen = fixed_model(), {}
    handle = ST.score_from_state(model, FEATURES_7, os.path.join(tmpdir_path, "state"), lambda d, e: seen.setdefault(e, []).append(sorted(map(tuple, d.collect()))))
    cut = F.lit(dt.datetime(2020, 10, 10)).cast("timestamp_ntz")
    for k, part in enumerate([bars.where(F.col("ts") < cut), bars.where((F.col("ts") >= cut) & (F.col("ticker") == "a")), bars.where((F.col("ts") >= cut) & (F.col("ticker") == "b"))]):
        handle(part, k)
    handle(bars.where((F.col("ts") >= cut) & (F.col("ticker") == "b")), 2)  # the last epoch runs again
    assert seen[2][0] == seen[2][1] and [r[0] for r in seen[1][0]] == ["a"]
    want = with_extent(I.indicators_core(to_spark(spark, walk("b", 290, 1)))).where("rpos = 0")
    want = model.transform(want.select("ticker", "ts", *[sanitize(c).alias(c) for c in FEATURES_7])).first()
    assert seen[2][0][0][:3] == ("b", want.ts, want.direction) and abs(seen[2][0][0][3] - want.confidence) < 1e-9
    assert ST.read_state(spark, os.path.join(tmpdir_path, "state")).agg(F.sum("n_rows")).first()[0] == 590


def test_pipeline_with_samme(spark, tmpdir_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import SQLTransformer
    from pricelens.operators.boost import fit_samme
    from pricelens.operators.samme_ml import SammeClassifier
    rows = I.add_label(I.indicators_core(to_spark(spark, walk("a", 500)))).checkpoint()
    names = ["rsi", "macd", "volume_ratio"]
    pipeline = Pipeline(stages=[SQLTransformer(statement="SELECT * FROM __THIS__ WHERE rsi IS NOT NULL"), SammeClassifier(inputCols=names, rounds=3, parts=2)])
    pipeline.write().overwrite().save(f"{tmpdir_path}/unfitted")
    fitted = Pipeline.load(f"{tmpdir_path}/unfitted").fit(rows)
    fitted.write().overwrite().save(f"{tmpdir_path}/fitted")
    again = PipelineModel.load(f"{tmpdir_path}/fitted")
    own = fit_samme(rows.dropna(subset=[*names, "target"]), names, rounds=3, parts=2)
    shown = lambda d: sorted((r.ts, r.decision, r.prediction) for r in d.collect())
    assert shown(again.transform(rows)) == shown(fitted.transform(rows)) == shown(own.transform(rows.where("rsi is not null")))
    assert again.stages[1].getOrDefault("rounds") == 3 and again.stages[1].uid == fitted.stages[1].uid
