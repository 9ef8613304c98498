"""Evaluation of scored test rows: accuracy, always-UP baseline, DOWN-class
precision/recall/F1, confusion matrix, classification report, exact ROC-AUC,
per-sector accuracy, split summary. Input columns: ``target`` (0/1),
``prediction`` (0/1), ``score`` (higher = more UP), optionally ``sector``/``part``.

Every metric is a distributed aggregate; the ROC-AUC prefix sum runs over score
buckets (bounded) and within buckets, never over all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.scalar import sdiv

C = F.col


def _counts(df: DataFrame, *keys: str) -> DataFrame:
    t, p = C("target"), C("prediction")
    return df.groupBy(*keys).agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 1) & (p == 1)).alias("tp"))


def confusion_matrix(df: DataFrame) -> DataFrame:
    return _counts(df)


def _z(x):
    """zero_division = 0"""
    return F.coalesce(x, F.lit(0.0))


def eval_metrics(df: DataFrame) -> DataFrame:
    """accuracy, baseline_always_up_acc, lift_over_baseline_pp, down_precision,
    down_recall, down_f1 (zero division -> 0), test_rows."""
    c = _counts(df)
    n = C("tn") + C("fp") + C("fn") + C("tp")
    acc = sdiv((C("tn") + C("tp")).cast("double"), n.cast("double"))
    base = sdiv((C("fn") + C("tp")).cast("double"), n.cast("double"))
    prec = _z(sdiv(C("tn").cast("double"), (C("tn") + C("fn")).cast("double")))
    rec = _z(sdiv(C("tn").cast("double"), (C("tn") + C("fp")).cast("double")))
    c = c.select(n.alias("test_rows"), acc.alias("accuracy"), base.alias("baseline_always_up_acc"),
                 prec.alias("down_precision"), rec.alias("down_recall"))
    return c.select("test_rows", "accuracy", "baseline_always_up_acc",
                    ((C("accuracy") - C("baseline_always_up_acc")) * 100).alias("lift_over_baseline_pp"),
                    "down_precision", "down_recall",
                    _z(sdiv(2 * C("down_precision") * C("down_recall"),
                            C("down_precision") + C("down_recall"))).alias("down_f1"))


def class_report(df: DataFrame) -> DataFrame:
    """Per-class precision/recall/F1/support for DOWN and UP, then 'macro avg' and
    'weighted avg' rows (zero division -> 0)."""
    c = _counts(df)
    tn, fp, fn, tp = (C(x).cast("double") for x in ("tn", "fp", "fn", "tp"))

    def cls(label, right, wrong_pred, wrong_true, support):
        p = _z(sdiv(right, right + wrong_pred))
        r = _z(sdiv(right, right + wrong_true))
        return F.struct(F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"),
                        _z(sdiv(2 * p * r, p + r)).alias("f1"), support.alias("support"))

    rows = c.select(F.explode(F.array(
        cls("DOWN", tn, fn, fp, tn + fp), cls("UP", tp, fp, fn, fn + tp))).alias("r")).select("r.*")
    tot = F.sum("support")
    macro = rows.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.alias("support"))
    wsum = lambda x: sdiv(F.sum(C(x) * C("support")), tot)
    weighted = rows.agg(F.lit("weighted avg").alias("label"), _z(wsum("precision")).alias("precision"),
                        _z(wsum("recall")).alias("recall"), _z(wsum("f1")).alias("f1"),
                        tot.alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def roc_auc(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """Exact ROC-AUC (ties count one half) = P(score_up > score_down) + P(tie) / 2.

    Rows are first grouped by distinct score (map-side combined), so a hot score is a
    single row. Distinct scores are cut into ``buckets`` ranges (as many as
    shuffle partitions) by approximate quantiles; negatives below each bucket come from a running sum over the bucket
    totals (``buckets`` rows), negatives below each score inside its bucket from a
    window per bucket. Null when only one class is present.
    """
    buckets = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # One row per distinct score; the planner reuses this exchange for the quantile cut,
    # the bucket totals and the in-bucket sums.
    g = df.groupBy("score").agg(F.count_if(C("target") == 1).alias("pos"),
                                F.count_if(C("target") == 0).alias("neg"))
    # Bucket boundaries: a bounded array of approximate quantiles, attached as a scalar
    # subquery.
    probs = [i / buckets for i in range(1, buckets)]
    cuts = g.select(F.percentile_approx("score", probs, 10000)).scalar()
    g = g.withColumn("__cuts", cuts)
    g = g.withColumn("bucket", F.size(F.filter("__cuts", lambda c: c < F.col("score")))).drop("__cuts")
    bt = g.groupBy("bucket").agg(F.sum("neg").alias("bneg"))
    bt = bt.withColumn("neg_before", F.coalesce(F.sum("bneg").over(
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy("bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("neg_in", F.coalesce(F.sum("neg").over(inner), F.lit(0)))
    j = g.join(F.broadcast(bt.select("bucket", "neg_before")), "bucket")
    s = j.agg(F.sum(C("pos") * (C("neg_before") + C("neg_in") + C("neg") / 2.0)).alias("u"),
              F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return s.select(F.when((C("P") > 0) & (C("N") > 0),
                           C("u") / (C("P").cast("double") * C("N"))).alias("roc_auc"))


def sector_accuracy(df: DataFrame) -> DataFrame:
    return df.groupBy("sector").agg(
        F.avg((C("prediction") == C("target")).cast("double")).alias("accuracy"),
        F.avg(C("target").cast("double")).alias("baseline"),
        F.count("*").alias("rows"))


def split_summary(df: DataFrame) -> DataFrame:
    """Rows and share of UP labels per split part."""
    return df.groupBy("part").agg(F.count("*").alias("rows"),
                                  (F.avg(C("target").cast("double")) * 100).alias("up_pct"))


def always_up(df: DataFrame) -> DataFrame:
    """The always-UP baseline classifier: prediction 1, score 1."""
    return df.withColumns({"prediction": F.lit(1), "score": F.lit(1.0)})
