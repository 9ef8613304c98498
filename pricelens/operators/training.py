"""The full training run: bars -> indicators -> label -> usable -> embargo split ->
SAMME fit -> evaluation -> model save -> metrics record appended to the run log."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.operators import evaluate as E
from pricelens.operators.boost import SammeModel, fit_samme, model_path
from pricelens.schema import FEATURES_7, FUNDAMENTALS_3

C = F.col


def importance_table(spark: SparkSession, model: SammeModel) -> DataFrame:
    """(feature, importance, rank) of a fitted model (one row per feature)."""
    imp = model.feature_importances
    rows = [(f, float(v)) for f, v in imp.items()]
    df = spark.createDataFrame(rows, "feature string, importance double")
    from pyspark.sql import Window
    return df.withColumn("rank", F.row_number().over(
        Window.orderBy(C("importance").desc(), C("feature"))))


def metrics_record(split: DataFrame, scored_test: DataFrame, model: SammeModel,
                   universe: DataFrame, rows_per_ticker: DataFrame, period: str = "10y",
                   horizon: int = 30, embargo: int = 30) -> DataFrame:
    """One-row metrics entry with nested columns (arrays, maps, struct); every part is
    an aggregate attached as a scalar subquery, no cartesian product."""
    spark = split.sparkSession
    ev = E.eval_metrics(scored_test)
    cm = E.confusion_matrix(scored_test)
    auc = E.roc_auc(scored_test.withColumn("score", C("p_up")))
    sect = E.sector_accuracy(scored_test)
    parts = split.where(C("part") != "embargo").groupBy("part").agg(
        F.count("*").alias("rows"), (F.avg(C("target").cast("double")) * 100).alias("up"))
    used = rows_per_ticker.select("ticker")
    skipped = universe.join(used, "ticker", "left_anti")
    imp = model.feature_importances
    imp_map = F.create_map(*[x for f in sorted(imp, key=lambda k: -imp[k])
                             for x in (F.lit(f), F.lit(float(imp[f])))])

    def sc(df, expr):
        return df.select(expr).scalar()

    now = _dt.datetime.now(_dt.timezone.utc).replace(microsecond=0).isoformat()
    return spark.range(1).select(
        F.lit(now).alias("retrained_at"), F.lit(period).alias("period"),
        F.lit(horizon).alias("horizon_days"),
        sc(rows_per_ticker, F.sort_array(F.collect_list("ticker"))).alias("tickers_used"),
        sc(skipped, F.sort_array(F.collect_list("ticker"))).alias("tickers_skipped"),
        sc(rows_per_ticker, F.map_from_entries(F.collect_list(F.struct("ticker", "n_rows"))))
        .alias("rows_per_ticker"),
        sc(rows_per_ticker, F.sum("n_rows")).alias("total_rows"),
        sc(ev, F.first("accuracy")).alias("accuracy"),
        sc(ev, F.first("baseline_always_up_acc")).alias("baseline_always_up_acc"),
        sc(ev, F.first("lift_over_baseline_pp")).alias("lift_over_baseline_pp"),
        sc(auc, F.first("roc_auc")).alias("roc_auc"),
        sc(ev, F.first("down_precision")).alias("down_precision"),
        sc(ev, F.first("down_recall")).alias("down_recall"),
        sc(ev, F.first("down_f1")).alias("down_f1"),
        sc(cm, F.first(F.struct("tn", "fp", "fn", "tp"))).alias("confusion_matrix"),
        sc(parts, F.sum(F.when(C("part") == "train", C("rows")))).alias("train_rows"),
        sc(parts, F.sum(F.when(C("part") == "test", C("rows")))).alias("test_rows"),
        sc(parts, F.max(F.when(C("part") == "train", C("up")))).alias("train_up_pct"),
        sc(parts, F.max(F.when(C("part") == "test", C("up")))).alias("test_up_pct"),
        sc(parts, F.max(F.when(C("part") == "test", C("up")))).alias("target_up_pct"),
        imp_map.alias("importance"),
        sc(sect, F.map_from_entries(F.collect_list(F.struct("sector", "accuracy"))))
        .alias("sector_accuracy"),
        F.lit("per_ticker_time_based_with_embargo").alias("split_method"),
        F.lit(embargo).alias("embargo_rows"),
        F.array(*[F.lit(f) for f in FUNDAMENTALS_3]).alias("fundamentals_dropped"),
    )


def train_run(split: DataFrame, universe: DataFrame, rows_per_ticker: DataFrame,
              rounds: int = 100, features=tuple(FEATURES_7), save_to: str | None = None,
              log_path: str | None = None) -> tuple[SammeModel, DataFrame]:
    """Fit on the 'train' part, evaluate on 'test', optionally save the model and
    append the metrics record to a Parquet run log (newest 50 kept)."""
    spark = split.sparkSession
    from pricelens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    # Materialise the split once (shared checkpoint folder): training and every
    # evaluation aggregate read it instead of recomputing bars and indicators.
    split = split.where(C("part") != "embargo").checkpoint(eager=True)
    train = split.where(C("part") == "train")
    test = split.where(C("part") == "test")
    model = fit_samme(train, list(features), rounds=rounds)
    scored = model.transform(test).checkpoint(eager=True)
    rec = metrics_record(split, scored, model, universe, rows_per_ticker)
    if save_to:
        model.save(spark, save_to)
    if log_path:
        from pricelens.operators.registry import write_log_version
        write_log_version(spark, log_path, rec, 50)
    return model, rec
