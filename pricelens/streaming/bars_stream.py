"""Structured Streaming: ticks -> tumbling OHLCV bars with a late-data bound, and
micro-batch scoring of the newest bar of every ticker a batch touched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col

EVENT_SCHEMA = ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
                "value DOUBLE, props STRING")


def tick_bars_stream(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA,
                     bar: str = "1 hour", watermark: str = "1 hour",
                     max_files: int | None = None) -> DataFrame:
    """Streaming bars from a folder of tick files: ticker = event_type, price = value,
    tick order (ts, event_id). Ticks later than ``watermark`` behind the newest
    seen time are dropped; a bar is final once the watermark passes its end
    (append mode), and its state is then released."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.parquet(path).withColumn("ts", C("ts").cast("timestamp"))
    k = F.struct("ts", "event_id")
    g = (s.withWatermark("ts", watermark)
          .groupBy(C("event_type").alias("ticker"), F.window("ts", bar).alias("w"))
          .agg(F.min_by("value", k).alias("open"), F.max("value").alias("high"),
               F.min("value").alias("low"), F.max_by("value", k).alias("close"),
               F.count("*").cast("double").alias("volume")))
    return g.select("ticker", C("w.start").cast("timestamp_ntz").alias("ts"),
                    "open", "high", "low", "close", "volume")


def write_bars_stream(bars: DataFrame, sink_path: str, name: str = "tick_bars",
                      available_now: bool = False):
    """Start the bar stream into a Parquet folder in append mode (each bar written once,
    when final). Offsets and aggregation state go to ``<spark.checkpoint.dir>/streams/
    <name>`` (the shared folder the cluster names), so a restarted query or a lost
    executor resumes from the last committed micro-batch without duplicating bars."""
    import os
    from pricelens.session import ensure_checkpoint_dir
    ckpt = os.path.join(ensure_checkpoint_dir(bars.sparkSession), "streams", name)
    w = (bars.writeStream.outputMode("append").format("parquet")
         .option("path", sink_path).option("checkpointLocation", ckpt))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def score_new_bars(model, history: DataFrame, features, sink):
    """``foreachBatch`` handler: for the tickers a micro-batch of bars touched, recompute the
    indicators over all their bars in ``history`` plus the batch, score each touched
    ticker's newest bar with ``model`` and hand ``(ticker, ts, direction, confidence)`` to
    ``sink(scores, epoch_id)`` (for example an idempotent write keyed by epoch). Values equal
    the batch ones, exponential averages included, since no bar is cut off; where both hold
    a bar, the batch's counts. Only touched tickers are read and scored: with ``history``
    partitioned by ticker the semi-join prunes its folders."""
    from pricelens.functions.scalar import sanitize
    from pricelens.operators import indicators as I
    from pricelens.operators.summary import with_extent

    def handle(batch: DataFrame, epoch_id: int) -> None:
        past = history.join(batch.select("ticker").distinct(), "ticker", "left_semi")
        past = past.join(batch.select("ticker", "ts"), ["ticker", "ts"], "left_anti")
        allb = past.unionByName(batch.dropDuplicates(["ticker", "ts"]), allowMissingColumns=True)
        ind = with_extent(I.indicators_core(allb)).where(C("rpos") == 0)
        x = ind.select("ticker", "ts", *[sanitize(c).alias(c) for c in features])
        scored = model.transform(x).select("ticker", "ts", "direction", "confidence")
        sink(scored, epoch_id)
    return handle
