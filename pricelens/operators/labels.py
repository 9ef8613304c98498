"""Training rows: history filter, usable rows, per-ticker embargo split, global split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.schema import FEATURES_7

C = F.col


def min_history(df: DataFrame, min_rows: int = 200) -> DataFrame:
    """Keep tickers with at least ``min_rows`` bars (window count on the ticker
    exchange the series windows use anyway)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    return df.withColumn("__n", n).where(C("__n") >= min_rows).drop("__n")


def usable_rows(df: DataFrame, features=tuple(FEATURES_7), label: str = "target") -> DataFrame:
    """Rows with every feature and the label present (training drops, scoring imputes)."""
    return df.dropna(subset=list(features) + [label])


def _time_order(df: DataFrame) -> list[str]:
    """Order within a ticker: the prepared (blk, pos) order when present (it is the
    sort the indicator windows already produced, so no new sort), else ts."""
    return ["blk", "pos"] if {"blk", "pos"} <= set(df.columns) else ["ts"]


def embargo_split(df: DataFrame, train_frac: float = 0.8, embargo: int = 30) -> DataFrame:
    """Per-ticker chronological split with an embargo gap.

    With n usable rows of a ticker (time order) and split = floor(n * train_frac):
    rows [0, max(0, split - embargo)) -> 'train', [split, n) -> 'test', the rows in
    between -> 'embargo' (discarded by training).
    """
    w = Window.partitionBy("ticker").orderBy(*_time_order(df))
    d = df.withColumns({"__i": F.row_number().over(w) - 1,
                        "__n": F.count(F.lit(1)).over(Window.partitionBy("ticker"))})
    split = F.floor(C("__n") * F.lit(float(train_frac)))
    cut = F.greatest(split - embargo, F.lit(0))
    part = (F.when(C("__i") < cut, F.lit("train"))
            .when(C("__i") < split, F.lit("embargo")).otherwise(F.lit("test")))
    return d.withColumn("part", part).withColumnRenamed("__i", "row_in_ticker").drop("__n")


def split_global(df: DataFrame, train_frac: float = 0.8) -> DataFrame:
    """Positional split over the rows concatenated ticker after ticker (ticker order,
    then time): the first floor(n * train_frac) rows are 'train'.

    Distributed: per-ticker counts (one row per ticker) get running offsets, which
    are joined back; each row's global position is offset + index in its ticker.
    Only the per-ticker count table is ordered globally, never the rows.
    """
    w = Window.partitionBy("ticker").orderBy(*_time_order(df))
    d = df.withColumn("__i", F.row_number().over(w) - 1)
    counts = d.groupBy("ticker").agg(F.count("*").alias("__c"))
    o = Window.orderBy("ticker").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("ticker", F.coalesce(F.sum("__c").over(o), F.lit(0)).alias("__off"),
                         F.sum("__c").over(Window.partitionBy()).alias("__total"))
    j = d.join(offs, "ticker")
    gp = C("__off") + C("__i")
    part = F.when(gp < F.floor(C("__total") * F.lit(float(train_frac))), "train").otherwise("test")
    return j.withColumns({"global_pos": gp, "part": part}).drop("__i", "__off", "__total")
