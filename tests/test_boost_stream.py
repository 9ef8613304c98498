"""Boosting, persistence, streaming bars, registry operators."""

import os
import shutil
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricelens.operators.boost import SammeModel, fit_samme, model_path


def toy(spark, n=400, seed=0):
    r = np.random.default_rng(seed)
    x1, x2 = r.normal(size=n), r.normal(size=n)
    y = ((x1 + 0.5 * x2) > 0).astype(int)
    pdf = pd.DataFrame({"x1": x1, "x2": x2, "target": y})
    return spark.createDataFrame(pdf)


def train_error(model, df):
    s = model.transform(df)
    return s.select(F.avg((F.col("prediction") != F.col("target")).cast("double"))).first()[0]


def test_boosting_learns_and_is_deterministic(spark):
    df = toy(spark).cache()
    m1 = fit_samme(df, ["x1", "x2"], rounds=1, max_depth=1)
    m6 = fit_samme(df, ["x1", "x2"], rounds=6, max_depth=1)
    assert train_error(m6, df) <= train_error(m1, df)
    assert train_error(m6, df) < 0.2
    again = fit_samme(df, ["x1", "x2"], rounds=6, max_depth=1)
    assert again.alphas == m6.alphas
    imp = m6.feature_importances
    assert abs(sum(imp.values()) - 1) < 1e-9 and imp["x1"] > imp["x2"]


def test_tree_columns_match_spark_ml(spark):
    """The CASE WHEN form of a fitted tree predicts what Spark ML predicts, and the
    weighted error read from its leaves equals the error of a scoring pass."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    from pricelens.operators.boost import leaf_error, tree_column, tree_spec
    r = np.random.default_rng(3)
    pdf = toy(spark, n=600, seed=3).toPandas()
    pdf["w"] = r.uniform(0.2, 3.0, size=len(pdf))
    pdf.loc[::17, "x2"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("y", F.col("target").cast("double"))
    v = VectorAssembler(inputCols=["x1", "x2"], outputCol="f", handleInvalid="keep").transform(df)
    tree = DecisionTreeClassifier(featuresCol="f", labelCol="y", weightCol="w", maxDepth=3) \
        .fit(v.where(~F.isnan("x2")))
    spec = tree_spec(tree)
    out = tree.transform(v).withColumn("mine", tree_column(spec, ["x1", "x2"])).toPandas()
    assert (out["prediction"] == out["mine"]).all()
    fit = out[~out["x2"].isna()]
    miss, tot = leaf_error(spec)
    np.testing.assert_allclose(miss, (fit["w"] * (fit["prediction"] != fit["y"])).sum(), rtol=1e-9)
    np.testing.assert_allclose(tot, fit["w"].sum(), rtol=1e-9)


def test_scores_and_roundtrip(spark):
    df = toy(spark, seed=1).cache()
    m = fit_samme(df, ["x1", "x2"], rounds=3)
    path = model_path(spark)
    m.save(spark, path)
    m2 = SammeModel.load(spark, path)
    a = m.transform(df).select("decision", "p_up", "confidence", "prediction").toPandas()
    b = m2.transform(df).select("decision", "p_up", "confidence", "prediction").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert a["decision"].between(-1, 1).all()
    assert ((a["decision"] > 0).astype(int) == a["prediction"]).all()
    assert (a["confidence"] >= 50).all()


def test_p_up_by_hand(spark):
    """Two stages of weight 3 and 1 on x <= 0: votes (DOWN, DOWN), (DOWN, UP), (UP, UP)
    give d = -1, -0.5, 1, hence P(UP) = 1 / (1 + e^2), 1 / (1 + e), 1 / (1 + e^-2)."""
    leaf = lambda c: ("leaf", float(c), [1.0, 1.0])
    m = SammeModel(["x"], [3.0, 1.0], [("split", 0, 1.0, leaf(0), leaf(1)), ("split", 0, 0.0, leaf(0), leaf(1))], [[1.0], [1.0]])
    got = m.transform(spark.createDataFrame([(-1.0,), (0.5,), (2.0,)], "x double")).toPandas()
    assert got["decision"].tolist() == [-1.0, -0.5, 1.0]
    np.testing.assert_allclose(got["p_up"], [0.11920292, 0.26894142, 0.88079708], rtol=1e-7)
    assert got["direction"].tolist() == ["DOWN", "DOWN", "UP"]
    np.testing.assert_allclose(got["confidence"], [88.079708, 73.105858, 88.079708], rtol=1e-7)


def test_fit_ignores_the_layout_and_leaves_nothing(spark):
    """More rows than Spark ML samples for split candidates, in two layouts: one model; no folder stays."""
    from pricelens.session import ensure_checkpoint_dir
    df = spark.range(90_000).select(F.rand(3).alias("x1"), F.randn(4).alias("x2"))
    df = df.withColumn("target", (F.col("x1") + 0.3 * F.col("x2") + 0.2 * F.randn(5) > 0.5).cast("int"))
    path = model_path(spark) + "-rows"
    df.write.parquet(path)
    rows = spark.read.parquet(path)
    one = fit_samme(rows.repartition(3), ["x1", "x2"], rounds=3)
    two = fit_samme(rows.orderBy("x2").repartition(11), ["x1", "x2"], rounds=3)
    assert one.alphas == two.alphas and one.specs == two.specs
    base = ensure_checkpoint_dir(spark).replace("file:", "")
    assert not [f for f in os.listdir(base) if f.startswith("boost-")]


def test_stream_bars_equal_batch(spark):
    from pricelens.sources.derived import event_bars
    from pricelens.streaming import tick_bars_stream
    src = tempfile.mkdtemp(prefix="pricelens-stream-")
    shutil.copy("/root/testdata/sf0.001/events.parquet", os.path.join(src, "part-0.parquet"))
    s = tick_bars_stream(spark, src)
    q = s.writeStream.outputMode("update").format("memory").queryName("sbars").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM sbars").toPandas().sort_values(["ticker", "ts"]).reset_index(drop=True)
    exp = event_bars(spark, "/root/testdata/sf0.001").toPandas().sort_values(["ticker", "ts"]).reset_index(drop=True)
    assert len(got) == len(exp)
    for c in ["open", "high", "low", "close", "volume"]:
        np.testing.assert_allclose(got[c], exp[c])


def test_stream_sink_checkpointed(spark):
    """Append-mode sink with its state under spark.checkpoint.dir: every bar closed by the
    watermark is written once and equals the batch bar."""
    from pricelens.sources.derived import event_bars
    from pricelens.streaming import tick_bars_stream, write_bars_stream
    src = tempfile.mkdtemp(prefix="pricelens-stream-src-")
    out = tempfile.mkdtemp(prefix="pricelens-stream-out-")
    shutil.copy("/root/testdata/sf0.001/events.parquet", os.path.join(src, "part-0.parquet"))
    q = write_bars_stream(tick_bars_stream(spark, src), out, name=os.path.basename(out),
                          available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(out).toPandas()
    exp = event_bars(spark, "/root/testdata/sf0.001").toPandas()
    newest = spark.read.parquet(src).agg(F.max("ts")).first()[0]
    closed = exp[exp["ts"] + pd.Timedelta(hours=2) <= pd.Timestamp(newest)]
    m = closed.merge(got, on=["ticker", "ts"], suffixes=("", "_s"))
    assert len(got) >= len(closed) > 0 and len(m) == len(closed)
    assert not got.duplicated(["ticker", "ts"]).any()
    for c in ["open", "high", "low", "close", "volume"]:
        np.testing.assert_allclose(m[c], m[c + "_s"])


def test_stream_sink_restart_resumes(spark):
    """A restarted query on the same checkpoint reads only the new file, closes the bars
    left open before the restart, and writes no bar twice."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pricelens.sources.bars import bars_from_ticks
    from pricelens.streaming import tick_bars_stream, write_bars_stream
    src = tempfile.mkdtemp(prefix="pricelens-stream-src-")
    out = tempfile.mkdtemp(prefix="pricelens-stream-out-")
    name = os.path.basename(out)
    t = pq.read_table("/root/testdata/sf0.001/events.parquet")
    pq.write_table(t, os.path.join(src, "part-0.parquet"))
    write_bars_stream(tick_bars_stream(spark, src), out, name=name, available_now=True) \
        .awaitTermination(300)
    first = spark.read.parquet(out).count()
    shift = pd.Timedelta(days=400)
    later = t.set_column(t.schema.get_field_index("ts"), "ts",
                         pc.add(t.column("ts"), pa_duration(shift)))
    later = later.set_column(later.schema.get_field_index("event_id"), "event_id",
                             pc.add(later.column("event_id"), 10 ** 9))
    pq.write_table(later, os.path.join(src, "part-1.parquet"))
    write_bars_stream(tick_bars_stream(spark, src), out, name=name, available_now=True) \
        .awaitTermination(300)
    got = spark.read.parquet(out).toPandas()
    assert len(got) > first and not got.duplicated(["ticker", "ts"]).any()
    ev = spark.read.parquet(src).withColumns({
        "ticker": F.col("event_type"), "one": F.lit(1.0),
        "hour": F.date_trunc("hour", "ts").cast("timestamp_ntz")})
    exp = bars_from_ticks(ev, ["ticker"], "hour", "value", "one", ["ts", "event_id"]).toPandas()
    newest = pd.Timestamp(spark.read.parquet(src).agg(F.max("ts")).first()[0])
    closed = exp[exp["ts"] + pd.Timedelta(hours=2) <= newest]
    m = closed.merge(got, on=["ticker", "ts"], suffixes=("", "_s"))
    assert len(m) == len(closed) == len(got)
    for c in ["open", "high", "low", "close", "volume"]:
        np.testing.assert_allclose(m[c], m[c + "_s"])


def pa_duration(td):
    import pyarrow as pa
    return pa.scalar(td.to_pytimedelta(), type=pa.duration("us"))


def test_log_retention_and_latest(spark):
    import datetime as dt
    from pricelens.operators import registry as G
    rows = [(f"p{i % 3}", dt.datetime(2025, 1, 1) + dt.timedelta(days=i), 0.5 + i / 1000) for i in range(70)]
    log = spark.createDataFrame(rows, "period string, retrained_at timestamp_ntz, accuracy double")
    kept = G.log_retention(log, 50).toPandas()
    assert len(kept) == 50 and kept.retrained_at.min() == dt.datetime(2025, 1, 21)
    latest = G.latest_entry(log).first()
    assert latest["accuracy"] == pytest.approx(0.569) and latest["source"] == "log"
    mt = spark.createDataFrame([(dt.datetime(2024, 5, 5),)], "mtime timestamp_ntz")
    assert G.latest_info(None, mt).first()["source"] == "mtime"
    assert G.latest_info(log, mt).first()["source"] == "log"
    empty = log.where("period = 'none'")
    assert tuple(G.latest_info(empty, mt).first()) == (dt.datetime(2024, 5, 5), None, "mtime")
    assert tuple(G.latest_info(empty, None).first()) == (None, None, "missing")
    assert tuple(G.latest_info(None, None, spark).first()) == (None, None, "missing")


def test_read_log_tolerant(spark, tmpdir_path):
    from pricelens.operators import registry as G
    schema = "retrained_at string, accuracy double"
    files = {"arr.json": '[{"retrained_at": "2025-01-01T00:00:00", "accuracy": 0.5},\n'
                         ' {"retrained_at": "2025-01-08T00:00:00", "accuracy": 0.6}]',
             "one.json": '{"retrained_at": "2025-02-01T00:00:00", "accuracy": 0.7}',
             "bad.json": '{"retrained_at": "2025-0'}
    for n, txt in files.items():
        with open(os.path.join(tmpdir_path, n), "w") as f:
            f.write(txt)
    count = {n: G.read_log(spark, os.path.join(tmpdir_path, n), schema).count() for n in files}
    assert count == {"arr.json": 2, "one.json": 1, "bad.json": 0}
    assert G.read_log(spark, os.path.join(tmpdir_path, "missing.json"), schema).count() == 0
    one = G.read_log(spark, os.path.join(tmpdir_path, "one.json"), schema)
    arr = G.read_log(spark, os.path.join(tmpdir_path, "arr.json"), schema)
    assert G.append_entry(arr, one, keep=2, order=("retrained_at",)).orderBy("retrained_at").toPandas()["accuracy"].tolist() == [0.6, 0.7]


def test_versioned_log(spark, tmpdir_path):
    """Each append writes the newest ``keep`` rows as a new version; readers see the newest."""
    import datetime as dt
    from pricelens.operators import registry as G
    base = os.path.join(tmpdir_path, "runlog")
    assert G.read_log_version(spark, base) == (None, -1)
    for i in range(4):
        e = spark.createDataFrame([("10y", dt.datetime(2025, 1, 1 + i), 0.5 + i / 10)],
                                  "period string, retrained_at timestamp_ntz, accuracy double")
        assert G.write_log_version(spark, base, e, keep=3) == i
    log, v = G.read_log_version(spark, base)
    got = log.orderBy("retrained_at").toPandas()
    assert v == 3 and got["accuracy"].round(6).tolist() == [0.6, 0.7, 0.8]
    more = spark.createDataFrame([("10y", dt.datetime(2025, 1, 9), 0.9, 0.55)],
                                 "period string, retrained_at timestamp_ntz, accuracy double, roc_auc double")
    G.write_log_version(spark, base, more, keep=3)
    again = spark.createDataFrame([("10y", dt.datetime(2025, 1, 10), 0.91)], "period string, retrained_at timestamp_ntz, accuracy double")
    G.write_log_version(spark, base, again, keep=3)
    got = G.read_log_version(spark, base)[0].orderBy("retrained_at").toPandas()
    assert got["roc_auc"].tolist()[1] == 0.55 and len(got) == 3  # the new column stays


def test_two_writers_keep_both_entries(spark, tmpdir_path):
    """Both saw version 0 and wrote a version 1: reading unites them."""
    import datetime as dt
    from pricelens.operators import registry as G
    base = os.path.join(tmpdir_path, "runlog2")
    entry = lambda day: spark.createDataFrame([("10y", dt.datetime(2025, 1, day), 0.5)], "period string, retrained_at timestamp_ntz, accuracy double")
    G.write_log_version(spark, base, entry(1))
    old = G.read_log_version(spark, base)[0]
    for k, day in (("aa", 2), ("bb", 3)):
        G.append_entry(old, entry(day)).write.parquet(f"{base}/v=1-{k}")
    got = G.read_log_version(spark, base)[0]
    assert sorted(r["retrained_at"].day for r in got.collect()) == [1, 2, 3]


def test_microbatch_scoring(spark):
    """New bars arrive as a stream; each batch scores the newest bar of the tickers
    it touched, equal to scoring the full history in batch."""
    from pyspark.sql import Window
    from pricelens.functions.scalar import sanitize
    from pricelens.operators import indicators as I
    from pricelens.operators.summary import with_extent
    from pricelens.schema import FEATURES_7
    from pricelens.sources.derived import bars
    from pricelens.streaming import score_new_bars
    b = bars(spark, "/root/testdata/sf0.001")
    last = with_extent(b).where(F.col("rpos") == 0).drop("pos", "blk", "n_rows", "rpos")
    hist = with_extent(b).where(F.col("rpos") > 0).drop("pos", "blk", "n_rows", "rpos")
    d = tempfile.mkdtemp(prefix="pricelens-bars-")
    hist.write.parquet(os.path.join(d, "history"))
    skip = sorted(r[0] for r in b.select("ticker").distinct().collect())[0]
    last.where(F.col("ticker") != skip).write.parquet(os.path.join(d, "incoming"))
    train = I.add_label(I.indicators_core(b)).dropna(subset=FEATURES_7 + ["target"])
    model = fit_samme(train, FEATURES_7, rounds=2)
    got = []
    handler = score_new_bars(model, spark.read.parquet(os.path.join(d, "history")), FEATURES_7,
                             lambda df, eid: got.extend(df.collect()))
    stream = spark.readStream.schema(b.schema).parquet(os.path.join(d, "incoming"))
    q = stream.writeStream.foreachBatch(handler).start()
    q.processAllAvailable()
    q.stop()
    full = with_extent(I.indicators_core(b)).where(F.col("rpos") == 0)
    exp = model.transform(full.select("ticker", "ts", *[sanitize(c).alias(c) for c in FEATURES_7]))
    exp = {r["ticker"]: (r["direction"], round(r["confidence"], 9)) for r in exp.collect()}
    res = {r["ticker"]: (r["direction"], round(r["confidence"], 9)) for r in got}
    assert skip not in res and len(res) == len(exp) - 1
    assert all(res[t] == exp[t] for t in res)


def test_retrain_job_twice(spark, tmpdir_path, capsys):
    """The batch retrain job: exit 0, one JSON record per run, one log version per run."""
    import json
    from pricelens.operators import registry as G
    from pricelens.plans import retrain
    out = os.path.join(tmpdir_path, "retrain")
    args = ["--sf", "/root/testdata/sf0.001", "--master", "local[4]", "--rounds", "2",
            "--out", out]
    assert retrain.main(args) == 0 and retrain.main(args) == 0
    recs = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert len(recs) == 2 and recs[0]["split_method"] == "per_ticker_time_based_with_embargo"
    log, v = G.read_log_version(spark, os.path.join(out, "log"))
    assert v == 1 and log.count() == 2
    assert retrain.main(["--bars", os.path.join(tmpdir_path, "missing"), "--out", out]) == 1
