"""The corpus pipeline: documents through quality, near copies, decontamination, secrets and packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir). ``run`` writes each
stage's rows as Parquet into the shared folder and rereads them as the next one's documents, so that a
lost executor repeats a part of one stage at most.
"""

from __future__ import annotations

from pricelens.llm.common import stored, table
from pricelens.llm.stages import contaminated, near_copies, packed, quality, secrets

STAGES = [("quality", quality), ("near_copies", near_copies), ("decontaminate", contaminated), ("secrets", secrets), ("pack", packed)]

#: The quality stage's trained model and the tokenizer can't be put in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
