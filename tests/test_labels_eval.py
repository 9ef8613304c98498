"""Labels, splits and evaluation metrics: edge cases and brute-force checks."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from frames import to_spark, walk
from pricelens.operators import evaluate as E
from pricelens.operators import indicators as I
from pricelens.operators import labels as L


def test_tail_label_strict_vs_compat(spark):
    b = to_spark(spark, walk("T", 65, 3))
    s = I.add_label(b, 30, "strict").toPandas().sort_values("ts")
    c = I.add_label(b, 30, "compat").toPandas().sort_values("ts")
    assert s["target"].iloc[-30:].isna().all() and s["target"].iloc[:35].notna().all()
    assert (c["target"].iloc[-30:] == 0).all()
    exp = (s["close"].shift(-30) / s["close"] - 1 > 0).astype(int).iloc[:35]
    assert list(s["target"].iloc[:35].astype(int)) == list(exp)


@pytest.mark.parametrize("n", [10, 37, 38, 100, 301])
def test_embargo_split_positions(spark, n):
    b = to_spark(spark, walk("E", n, n))
    got = L.embargo_split(b).toPandas().sort_values("ts")
    split = int(n * 0.8)
    cut = max(0, split - 30)
    exp = ["train"] * cut + ["embargo"] * (split - cut) + ["test"] * (n - split)
    assert list(got["part"]) == exp


def test_embargo_split_invariants(spark):
    pdf = pd.concat([walk("A", 400, 1), walk("B", 150, 2)])
    g = L.embargo_split(to_spark(spark, pdf)).toPandas()
    for t, x in g.groupby("ticker"):
        tr, te = x[x.part == "train"], x[x.part == "test"]
        assert set(tr.ts).isdisjoint(te.ts)
        assert te.row_in_ticker.min() - tr.row_in_ticker.max() > 30


def test_split_global_matches_positional(spark):
    pdf = pd.concat([walk("B", 50, 1), walk("A", 70, 2), walk("C", 33, 3)])
    g = L.split_global(to_spark(spark, pdf)).toPandas().sort_values(["ticker", "ts"])
    n = len(pdf)
    assert list(g["global_pos"]) == list(range(n))
    assert (g["part"] == "train").sum() == int(n * 0.8)


def test_min_history(spark):
    pdf = pd.concat([walk("A", 199, 1), walk("B", 200, 2)])
    g = L.min_history(to_spark(spark, pdf), 200).toPandas()
    assert set(g.ticker) == {"B"}


def preds(spark, rows):
    return spark.createDataFrame(rows, "ticker string, sector string, target int, prediction int, score double")


def test_single_class(spark):
    rows = [("x", "S", 1, 1, float(i)) for i in range(10)]
    d = preds(spark, rows)
    assert E.roc_auc(d).first()["roc_auc"] is None
    m = E.eval_metrics(d).first()
    assert m["down_precision"] == 0 and m["down_recall"] == 0 and m["down_f1"] == 0
    assert m["accuracy"] == 1.0 and m["baseline_always_up_acc"] == 1.0


def brute_auc(rows):
    pos = [r[4] for r in rows if r[2] == 1]
    neg = [r[4] for r in rows if r[2] == 0]
    s = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p, q in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_auc_vs_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [("x", "S", rnd.randint(0, 1), 0, float(rnd.randint(0, 40))) for _ in range(400)]
    got = E.roc_auc(preds(spark, rows), buckets=16).first()["roc_auc"]
    assert got == pytest.approx(brute_auc(rows), abs=1e-12)


def test_confusion_and_report(spark):
    rnd = random.Random(5)
    rows = [("x", rnd.choice("ST"), rnd.randint(0, 1), rnd.randint(0, 1), 0.0) for _ in range(300)]
    d = preds(spark, rows)
    cm = E.confusion_matrix(d).first()
    assert cm["tn"] + cm["fp"] + cm["fn"] + cm["tp"] == 300
    tn = sum(1 for r in rows if r[2] == 0 and r[3] == 0)
    fn = sum(1 for r in rows if r[2] == 1 and r[3] == 0)
    fp = sum(1 for r in rows if r[2] == 0 and r[3] == 1)
    rep = {r["label"]: r for r in E.class_report(d).collect()}
    assert rep["DOWN"]["precision"] == pytest.approx(tn / (tn + fn))
    assert rep["DOWN"]["recall"] == pytest.approx(tn / (tn + fp))
    assert rep["macro avg"]["support"] == 300
    base = E.eval_metrics(E.always_up(d)).first()
    assert base["accuracy"] == pytest.approx(np.mean([r[2] for r in rows]))


def test_short_histories_are_left_out(spark):
    """The board shows no ticker of fewer than 200 bars."""
    from frames import to_spark, walk
    from pricelens.plans.catalog import signal_board
    pdf = pd.concat([walk("LONG", 200, 1), walk("SHORT", 199, 2)])
    assert [r["ticker"] for r in signal_board(to_spark(spark, pdf)).collect()] == ["LONG"]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_landed_bars_with_integer_volume(spark, tmpdir_path, kind):
    from pricelens.sources.bars import read_bars
    df = spark.sql(f"SELECT 'A' AS ticker, 'S' AS sector, CAST('2024-01-02 00:00:00' AS {kind}) AS ts, 1.0D AS open, 3.0D AS high, "
                   "0.5D AS low, double('NaN') AS close, 12345678901L AS volume")
    df.write.parquet(tmpdir_path + "/bars")
    got = read_bars(spark, tmpdir_path + "/bars").first()
    assert got["volume"] == 12345678901.0 and got["close"] is None and got["ts"].isoformat() == "2024-01-02T00:00:00"
