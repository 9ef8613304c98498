"""Indicator state of every ticker, carried on from bar to bar instead of read again from the history.

One row a ticker: the sums behind the exponential averages, the running peak and the last ``RING`` bars. A
micro-batch's bars are folded into the state of the tickers it touches, in built-in functions; the newest
bar's indicators follow from the state alone. Each epoch writes its own version of the table, made from the
version before it, so an epoch that is run again after a failure writes the same rows and counts nothing twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions.scalar import sanitize, sdiv
from pricelens.operators.indicators import _rsi_value
from pricelens.session import remove_folder

C = F.col

#: Bars kept of each ticker (the longest window is 200), and versions of the table that stay.
RING, KEEP = 252, 3
SPANS = {"12": 12, "26": 26, "9": 9}
SUMS = "struct<n12: double, d12: double, n26: double, d26: double, n9: double, d9: double>"
STATE = f"ticker string, last_ts timestamp_ntz, n_rows long, peak double, sums {SUMS}, ring array<struct<ts: timestamp_ntz, close: double, volume: double>>, epoch long"


def _decay(span: int) -> float:
    return 1 - 2 / (span + 1)


def _step(s, x):
    """The sums after one more bar: a weighted total and its weight for each span, the third over the MACD line."""
    seen, value = x["close"].isNotNull().cast("double"), F.coalesce(x["close"], F.lit(0.0))
    n = {k: s[f"n{k}"] * _decay(SPANS[k]) + value for k in ("12", "26")}
    d = {k: s[f"d{k}"] * _decay(SPANS[k]) + seen for k in ("12", "26")}
    line = sdiv(n["12"], d["12"]) - sdiv(n["26"], d["26"])
    n["9"] = s["n9"] * _decay(9) + F.coalesce(line, F.lit(0.0))
    d["9"] = s["d9"] * _decay(9) + line.isNotNull().cast("double")
    return F.struct(*[f(k) for k in SPANS for f in (lambda k: n[k].alias(f"n{k}"), lambda k: d[k].alias(f"d{k}"))])


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def advance(state: DataFrame, bars: DataFrame, epoch: int) -> DataFrame:
    """``state`` after the new ``bars`` (ticker, ts, close, volume) of a micro-batch.

    Bars at or before a ticker's newest one have been counted or came too late, and change nothing; of several bars
    at one time the least by its values counts. Bars without a ticker or time are left out.
    """
    at = F.struct("ts", "close", "volume")
    new = bars.where("ticker is not null and ts is not null").groupBy("ticker", "ts").agg(F.min(at).alias("bar"))
    new = new.groupBy("ticker").agg(F.sort_array(F.collect_list("bar")).alias("__new"))
    d = state.join(new, "ticker", "full")
    some = F.filter(F.coalesce("__new", F.array().cast("array<struct<ts: timestamp_ntz, close: double, volume: double>>")),
                    lambda b: C("last_ts").isNull() | (b["ts"] > C("last_ts")))
    d = d.withColumn("__new", some).withColumn("__n", F.size("__new"))
    zero = F.struct(*[F.lit(0.0).alias(f"{x}{k}") for k in SPANS for x in ("n", "d")])
    ring = F.concat(F.coalesce("ring", F.array().cast("array<struct<ts: timestamp_ntz, close: double, volume: double>>")), C("__new"))
    return d.select(
        "ticker", F.coalesce(F.element_at("__new", F.when(C("__n") > 0, -1))["ts"], C("last_ts")).alias("last_ts"), (F.coalesce("n_rows", F.lit(0)) + C("__n")).cast("long").alias("n_rows"),
        F.greatest("peak", F.array_max(F.transform("__new", lambda b: b["close"]))).alias("peak"),
        F.aggregate("__new", F.coalesce("sums", zero), _step).alias("sums"),
        F.slice(ring, F.greatest(F.lit(1), F.size(ring) - RING + 1), RING).alias("ring"),
        F.when(C("__n") > 0, F.lit(epoch)).otherwise(C("epoch")).cast("long").alias("epoch"))


def _last(values, n: int):
    """The newest n values, null unless there are so many and none is null."""
    some = F.slice(values, F.greatest(F.lit(1), F.size(values) - n + 1), n)
    return F.when((F.size(values) >= n) & ~F.exists(some, lambda x: x.isNull()), some)


def _mean(some, n: int):
    return F.aggregate(some, F.lit(0.0), lambda s, x: s + x) / n


def _std(some, n: int):
    m = _mean(some, n)
    return F.sqrt(F.aggregate(F.transform(some, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x) / (n - 1))


def features(state: DataFrame) -> DataFrame:
    """(ticker, ts, close and indicators) of each ticker's newest bar, out of its state."""
    d = state.select("ticker", "epoch", "peak", "sums", "n_rows", F.transform("ring", lambda b: b["close"]).alias("__c"), F.transform("ring", lambda b: b["volume"]).alias("__v"),
                     C("last_ts").alias("ts"))
    # changes from bar to bar; the first bar of all has none, which counts as no gain and no loss
    d = d.withColumn("__d", F.transform(F.sequence(F.lit(1), F.size("__c")), lambda i: F.when(i > 1, F.get("__c", i - 1) - F.get("__c", i - 2))))
    d = d.withColumn("__r", F.transform(F.sequence(F.lit(1), F.size("__c")), lambda i: F.when(i > 1, sdiv(F.get("__c", i - 1), F.get("__c", i - 2)) - 1)))
    d = d.withColumns({"close": F.element_at("__c", -1), "volume": F.element_at("__v", -1), "daily_return": F.element_at("__r", -1)})
    gains, losses = (F.transform("__d", lambda x: F.when(s * x > 0, s * x).otherwise(0.0)) for s in (1, -1))
    d = d.withColumns({"__g": _last(gains, 14), "__l": _last(losses, 14), "__20": _last(C("__c"), 20), "__v20": _last(C("__v"), 20), "__r30": _last(C("__r"), 30),
                       "__c50": _last(C("__c"), 50), "__c200": _last(C("__c"), 200)})
    d = d.withColumns({"__ag": _mean(C("__g"), 14), "__al": _mean(C("__l"), 14), "__m": _mean(C("__20"), 20), "__s": _std(C("__20"), 20)})
    macd = sdiv(C("sums.n12"), C("sums.d12")) - sdiv(C("sums.n26"), C("sums.d26"))
    lower = C("__m") - 2.0 * C("__s")
    return d.select(
        "ticker", "ts", "close", "n_rows", "epoch", _rsi_value(C("__ag"), C("__al")).alias("rsi"), macd.alias("macd"), (macd - sdiv(C("sums.n9"), C("sums.d9"))).alias("macd_hist"),
        sdiv(C("close") - lower, 4.0 * C("__s")).alias("bb_position"), sdiv(C("volume"), _mean(C("__v20"), 20)).alias("volume_ratio"),
        _std(C("__r30"), 30).alias("volatility"), "daily_return", _mean(C("__c50"), 50).alias("sma_50"), _mean(C("__c200"), 200).alias("sma_200"),
        (sdiv(C("close") - C("peak"), C("peak")) * 100).alias("drawdown"))


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Epoch -> folder of the versions whose job has committed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return {}
    found = [str(s.getPath()) for s in fs.listStatus(base) if s.isDirectory()]
    return {int(m[1]): f for f in found if (m := re.search(r"epoch=(\d+)$", f)) and fs.exists(hadoop.Path(f, "_SUCCESS"))}


def read_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest version, or the newest of an earlier epoch than ``before``."""
    known = {e: f for e, f in versions(spark, path).items() if before is None or e < before}
    return spark.read.schema(STATE).parquet(known[max(known)]) if known else empty_state(spark)


def score_from_state(model, names, path: str, sink):
    """``foreachBatch`` handler: fold the batch into the state at ``path`` and hand the scores of the tickers it touched,
    (ticker, ts, direction, confidence), to ``sink(scores, epoch_id)``. No history is read."""

    def handle(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        advance(read_state(spark, path, epoch_id), batch, epoch_id).write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")
        now = features(read_state(spark, path, epoch_id + 1).where(C("epoch") == epoch_id))
        scored = model.transform(now.select("ticker", "ts", *[sanitize(c).alias(c) for c in names]))
        sink(scored.select("ticker", "ts", "direction", "confidence"), epoch_id)
        for old, folder in versions(spark, path).items():
            if old <= epoch_id - KEEP:
                remove_folder(spark, folder)

    return handle
