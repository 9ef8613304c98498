"""The pipeline's stages: (spark, docs, sf_dir) -> documents, but for the last, which returns sequences.

Each acts on all rows its predecessor kept. A row with a null id is kept by the stages that compare
documents, since nothing can be said about it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontaminate, minhash, packing, secrets as secret_scan, quality as quality_rules
from .common import flat, stored, table

#: Near copies share this many hundredths of their word 5-shingles or more (op9's contract has 85).
NEAR = 80


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the model reject go. The model is trained on the labelled ones among ``docs``."""
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return flat(quality_rules.score(docs, model, docs.columns).where("kept"), docs.columns, [])


def near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id; of rows that repeat its id, one."""
    groups = minhash.near_copies(docs, threshold=NEAR)
    ids = stored(groups.where("id is not null").groupBy("id").agg(F.min("component_id").alias("first"), F.count("*").alias("rows")), "groups")
    kept = docs.join(ids.where("id != first").select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_anti")
    again = ids.where("rows > 1").select(F.col("id").alias("doc_id"))
    if again.limit(1).count():  # few rows: only these are compared by their ids
        kept = kept.join(again, "doc_id", "left_anti").union(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(docs.columns)


def contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), docs.columns)
    return flat(found.where(F.size("ranges") == 0), docs.columns, [])


def secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span is masked; ``n_chars`` follows the text."""
    found = secret_scan.scan(docs, docs.columns)
    hit = F.size("spans") > 0
    found = found.withColumn("masked", F.when(hit, secret_scan.redacted(F.col("text"), F.col("spans"))))
    new = {"text": F.when(hit, F.col("masked")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: one row for each piece of a document."""
    return packing.pack_documents(docs, ["doc_id"])
