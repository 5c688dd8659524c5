"""The corpus pipeline: five stages over ``documents``.

Each stage takes what the one before kept and returns the columns of
``documents``; the last returns the token ids of what is left.  The stages read
their input several times, so each result is written to the shared folder and
read again, here as by the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import queries as q
from tidewater.llm.common import settle

STAGES = [
    ("quality_classifier", q.stage_quality),
    ("line_dedup", q.stage_line_dedup),
    ("near_dedup", q.stage_near_dedup),
    ("decontamination", q.stage_decontaminate),
    ("bpe_encoding", q.stage_encode),
]

# the classifier, the rolling hash and the encoder have no SQL form;
# tests/llm/test_pipeline.py holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = q.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs)
    return docs
