"""Corpus pipeline: stages that read documents and write what stays of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetrace.llm import pipeline_stages as stages
from kinetrace.llm.common import documents, materialize

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("exact_dedup", stages.drop_exact_copies),
    ("near_dedup", stages.drop_near_copies),
    ("packing", stages.pack_documents),
]

#: Learned scores, near-duplicate classes and token ids are beyond SQL; tests hold
#: each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
