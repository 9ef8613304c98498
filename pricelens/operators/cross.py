"""Point-in-time joins, walk-forward folds, and figures across the instruments of one date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def asof_join(left: DataFrame, right: DataFrame, values: list[str], key: str = "ticker", ts: str = "ts",
              right_ts: str = "as_of", prefix: str = "") -> DataFrame:
    """Each row of ``left`` with the newest row of ``right`` of its key that isn't later: ``right_ts`` and ``values``.

    Both streams are united, sorted by time once, and the last snapshot goes along: no range join, one exchange
    on the key. A snapshot of the row's own time counts. A snapshot is taken whole, so a null in it stays null;
    of several at one time the greatest by their values counts. Rows before the first snapshot, or without a
    key, get nulls.
    """
    snap = F.struct(C(right_ts), *[C(v) for v in values])
    columns = left.columns
    rows = left.select(F.struct(*[C(f"`{c}`") for c in columns]).alias("__row"), C(key).alias("__k"), C(ts).alias("__t"))
    rows = rows.withColumns({"__side": F.lit(1), "__snap": F.lit(None).cast(right.select(snap.alias("s")).schema["s"].dataType)})
    snaps = right.where(C(key).isNotNull() & C(right_ts).isNotNull()).select(
        F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), C(key).alias("__k"), C(right_ts).alias("__t"), F.lit(0).alias("__side"), snap.alias("__snap"))
    w = Window.partitionBy("__k").orderBy("__t", "__side", "__snap").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(snaps).withColumn("__snap", F.last("__snap", ignorenulls=True).over(w)).where(C("__side") == 1)
    return both.select(*[C("__row")[c].alias(c) for c in columns], *[C("__snap")[v].alias(prefix + v) for v in [right_ts, *values]])


def fold_starts(df: DataFrame, folds: int = 5, ts: str = "ts") -> DataFrame:
    """(fold, start, stop): the distinct dates in ``folds + 1`` runs of equal length; run k is fold k's test part.

    There is one row a date, so their order is a small window.
    """
    dates = df.select(C(ts).alias("__t")).distinct()
    numbered = dates.withColumns({"__i": F.row_number().over(Window.orderBy("__t")) - 1, "__n": F.count("*").over(Window.partitionBy())})
    fold = F.floor(C("__i") * (folds + 1) / C("__n"))
    runs = numbered.withColumn("fold", F.least(fold, F.lit(folds))).groupBy("fold").agg(F.min("__t").alias("start"), F.max("__t").alias("stop"))
    return runs.where("fold > 0").select(C("fold").cast("int").alias("fold"), "start", "stop")


def walk_forward(df: DataFrame, folds: int = 5, horizon: int = 30, key: str = "ticker", ts: str = "ts",
                 order: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` once for each fold they take part in: ``fold`` and ``part`` ('train', 'purged', 'test').

    Fold k tests on the k-th run of dates and trains on all dates before it (expanding). A row whose label looks
    ``horizon`` bars ahead to the test part's first date or beyond would leak, so it is purged. A row that has no
    bar that far ahead trains nothing either.
    """
    ends = F.lead(ts, horizon).over(Window.partitionBy(key).orderBy(*(order or [ts])))
    starts = fold_starts(df, folds, ts).select(F.sort_array(F.collect_list(F.struct("fold", "start", "stop")))).scalar()  # one entry a fold
    every = df.withColumn("__end", ends).withColumn("__f", F.explode(starts)).where(C(ts) <= C("__f.stop"))
    part = F.when(C(ts) >= C("__f.start"), "test").when(C("__end") < C("__f.start"), "train").otherwise("purged")
    return every.withColumns({"fold": C("__f.fold"), "part": part}).drop("__end", "__f")


def fold_metrics(parts: DataFrame, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """One row a fold: sizes, the share of UP in both parts, accuracy, and that of the training part's majority."""
    of = lambda p, x: F.avg(F.when(C("part") == p, x))
    up = C(target).cast("double")
    sums = parts.groupBy("fold").agg(
        F.count_if(C("part") == "train").alias("train_rows"), F.count_if(C("part") == "purged").alias("purged_rows"), F.count_if(C("part") == "test").alias("test_rows"),
        of("train", up).alias("train_up"), of("test", up).alias("test_up"), of("test", (C(prediction) == C(target)).cast("double")).alias("accuracy"))
    majority = F.when(C("train_up") > 0.5, C("test_up")).otherwise(F.lit(1.0) - C("test_up"))
    return sums.withColumn("majority_acc", F.when(C("train_up").isNotNull(), majority))


def sector_relative(df: DataFrame, value: str, group: str = "sector", ts: str = "ts") -> DataFrame:
    """``peers``, the mean of ``value`` over the group's other members on the same date, and ``relative`` to it.

    One sum and count per (group, date), the own value taken out; null where there is no other member or no value.
    """
    w = Window.partitionBy(group, ts)
    n, total = F.count(value).over(w), F.sum(value).over(w)
    return (df.withColumns({"__n": n, "__s": total})
              .withColumn("peers", F.when(C(value).isNotNull() & (C("__n") > 1), (C("__s") - C(value)) / (C("__n") - 1)))
              .withColumn("relative", C(value) - C("peers")).drop("__n", "__s"))


def cross_rank(df: DataFrame, value: str, ts: str = "ts", parts: int | None = None) -> DataFrame:
    """``rank`` (ties share the least), ``n`` and ``pct_rank`` of ``value`` among all rows of the date; null values have none.

    Equal values are counted first, next to the scan. The values of all dates are cut into ranges at approximate
    quantiles; ranks are the counts of the ranges below plus those of the smaller values of the own range, so a
    date with very many instruments is as many tasks as ranges, and no exchange carries a date as one key.
    """
    parts = max(2, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    has = df.where(C(value).isNotNull())
    cuts = has.select(F.percentile_approx(value, [k / parts for k in range(1, parts)], 1000)).scalar()
    counts = has.groupBy(C(ts).alias("__t"), C(value).alias("__v")).agg(F.count("*").alias("__c"))
    counts = counts.withColumn("__cuts", cuts).withColumn("__r", F.size(F.filter("__cuts", lambda c: c < C("__v")))).drop("__cuts")
    ranges = counts.groupBy("__t", "__r").agg(F.sum("__c").alias("__rc"))
    up_to = Window.partitionBy("__t").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("__t", "__r", F.coalesce(F.sum("__rc").over(up_to), F.lit(0)).alias("__below"), F.sum("__rc").over(Window.partitionBy("__t")).alias("n"))
    inside = Window.partitionBy("__t", "__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("__less", F.coalesce(F.sum("__c").over(inside), F.lit(0))).join(ranges, ["__t", "__r"])
    ranked = ranked.select("__t", "__v", (C("__below") + C("__less") + 1).alias("rank"), "n")
    pct = F.when(C("n") > 1, (C("rank") - 1) / (C("n") - 1)).when(C("n") == 1, F.lit(0.0))
    out = df.join(ranked, (C(ts) == C("__t")) & (C(value) == C("__v")), "left").drop("__t", "__v")
    return out.withColumn("pct_rank", pct)
