"""Landed bars as a store: Parquet by month, corrected by the month, with the newest date of every ticker beside it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.schema import BARS

C = F.col
MONTH = "yyyy-MM"


def land_bars(bars: DataFrame, path: str) -> None:
    """Write ``bars`` into the store at ``path``: the months they hold are replaced, all others stay.

    A correction must therefore bring whole months. A month is one folder, written by few tasks (its rows are
    dealt by month and ticker hash), and replaced when its job has committed, so a lost executor or a job run
    twice leaves no bar double.
    """
    spark = bars.sparkSession
    d = bars.select(*[C(f.name).cast(f.dataType).alias(f.name) for f in BARS.fields], F.date_format("ts", MONTH).alias("month"))
    dealt = d.repartition("month", F.pmod(F.xxhash64("ticker"), F.lit(4)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{path}/bars")
    refresh_recent(spark, path)


def read_store(spark: SparkSession, path: str, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
    """The bars from ``since`` on, before ``until``: other months' folders aren't listed, other rows not read."""
    d = spark.read.schema(T.StructType([*BARS.fields, T.StructField("month", T.StringType())])).parquet(f"{path}/bars")
    if since is not None:
        d = d.where((C("month") >= since.strftime("%Y-%m")) & (C("ts") >= F.lit(since).cast("timestamp_ntz")))
    if until is not None:
        d = d.where((C("month") <= until.strftime("%Y-%m")) & (C("ts") < F.lit(until).cast("timestamp_ntz")))
    return d.drop("month")


def refresh_recent(spark: SparkSession, path: str) -> None:
    """Newest date and number of bars of each ticker, one small table, written anew beside the store."""
    d = read_store(spark, path).groupBy("ticker").agg(F.max("ts").alias("ts"), F.count("*").alias("n_rows"))
    d.write.mode("overwrite").parquet(f"{path}/recent")


def recent(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, ts, n_rows): enough for the existence probe of the resolver and the minimum history."""
    return spark.read.schema("ticker string, ts timestamp_ntz, n_rows long").parquet(f"{path}/recent")
