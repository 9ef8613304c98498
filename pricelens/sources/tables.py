"""Parquet table access. Column selection happens right after the read so the
scan's ReadSchema carries only the needed columns."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Read ``name`` with only ``cols``; the scan's own splits are the input partitions."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*cols) if cols else df
