"""Run log (retention, latest entry, staleness) and model-file fallbacks."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.operators.signals import staleness
from pricelens.session import remove_folder

C = F.col


def log_retention(log: DataFrame, keep: int = 50, order=("retrained_at", "period")) -> DataFrame:
    """Newest ``keep`` entries (append order = ``order``): a distributed top-k."""
    return log.orderBy(*[C(c).desc() for c in order]).limit(keep)


def append_entry(log: DataFrame, entry: DataFrame, keep: int = 50,
                 order=("retrained_at", "period")) -> DataFrame:
    """History plus the new entry, newest ``keep`` kept (by column name, missing
    columns null)."""
    return log_retention(log.unionByName(entry, allowMissingColumns=True), keep, order)


def read_log(spark, path: str, schema) -> DataFrame:
    """Tolerant read of a JSON log: a missing path reads as empty, a corrupt file is
    dropped (empty), a single object reads as one row, an array as its elements."""
    from pyspark.errors import AnalysisException
    try:
        return (spark.read.schema(schema).option("mode", "DROPMALFORMED")
                .option("multiLine", "true").json(path))
    except AnalysisException:
        return spark.createDataFrame([], schema)


VERSION = r"/v=(\d+)-[0-9a-f]+$"


def log_versions(spark, base: str) -> list[tuple[int, str]]:
    """(number, folder) of the committed versions under ``base``, oldest first; none if it's missing.
    A version counts once its job has left ``_SUCCESS``; there are as many as retrain runs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [str(s.getPath()) for s in fs.listStatus(path) if s.isDirectory()]
    done = [f for f in found if re.search(VERSION, f) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted((int(re.search(VERSION, f)[1]), f) for f in done)


def read_log_version(spark, base: str) -> tuple[DataFrame | None, int]:
    """Newest state of a versioned Parquet log and its number; ``(None, -1)`` without one. Two runs
    that wrote the same number side by side both count: their rows are united, by column name."""
    found = log_versions(spark, base)
    if not found:
        return None, -1
    v = found[-1][0]
    newest = [spark.read.parquet(f) for n, f in found if n == v]
    out = newest[0]
    for other in newest[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return (out.dropDuplicates(["retrained_at", "period"]) if len(newest) > 1 else out), v


def write_log_version(spark, base: str, entry: DataFrame, keep: int = 50) -> int:
    """Write the newest ``keep`` rows of history and ``entry`` as the next version, a folder of its
    own (``v=<n>-<run>``), so nothing that is read is overwritten, a new column stays, and two runs
    at once keep both entries. Versions before the last two are removed afterwards."""
    old, v = read_log_version(spark, base)
    new = entry if old is None else append_entry(old, entry, keep)
    new.write.parquet(f"{base}/v={v + 1}-{uuid.uuid4().hex}")
    for n, folder in log_versions(spark, base):
        if n < v:
            remove_folder(spark, folder)
    return v + 1


def latest_entry(log: DataFrame, order=("retrained_at", "period")) -> DataFrame:
    """Newest entry as one row: retrained_at, accuracy, source='log'."""
    k = F.struct(*[C(c) for c in order])
    return log.agg(F.max_by(F.struct("retrained_at", "accuracy"), k).alias("e")).select(
        "e.retrained_at", "e.accuracy", F.lit("log").alias("source"))


def latest_info(log: DataFrame | None, model_mtime: DataFrame | None, spark=None) -> DataFrame:
    """Fallback chain, one row: the newest log entry; without one (no log, or an empty or corrupt one)
    the model file's time; without that ``(null, null, 'missing')``."""
    parts = []
    if log is not None:
        parts.append(latest_entry(log).where(C("retrained_at").isNotNull()).withColumn("prio", F.lit(1)))
    if model_mtime is not None:
        parts.append(model_mtime.where(C("mtime").isNotNull()).select(
            C("mtime").alias("retrained_at"), F.lit(None).cast("double").alias("accuracy"), F.lit("mtime").alias("source"), F.lit(2).alias("prio")))
    spark = spark or next(d for d in (log, model_mtime) if d is not None).sparkSession
    kind = parts[0].schema["retrained_at"].dataType if parts else T.TimestampNTZType()
    u = spark.range(1).select(F.lit(None).cast(kind).alias("retrained_at"), F.lit(None).cast("double").alias("accuracy"),
                              F.lit("missing").alias("source"), F.lit(3).alias("prio"))
    for p in parts:
        u = u.unionByName(p)
    return u.agg(F.min_by(F.struct("retrained_at", "accuracy", "source"), "prio").alias("e")).select("e.*")


def log_staleness(log: DataFrame, now) -> DataFrame:
    """Age in days against ``now`` and the staleness band (missing time -> 999 days)."""
    secs = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(C("retrained_at").cast("timestamp"))
    age = F.coalesce(F.floor(secs / 86400), F.lit(999))
    return log.withColumn("age_days", age).withColumn("staleness", staleness(C("age_days")))
