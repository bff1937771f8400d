"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir).

For all of them: a null text counts as empty, a null id is an id of its own, an
empty table gives no rows, texts of any length are read whole, and columns beside
id and text are handed on untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, near_dedup, packing, toxicity
from .common import id_remainder, materialize
from .queries import PATTERN, TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go, each row by itself; empty ones stay. The model learns from the labels of rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, id_remainder(4) != 2)
    return toxicity.keep_clean(docs, model, threshold=0.3)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null counts as empty, a null id as smallest, of repeated rows one stays."""
    index = exact_dedup.scratch_index(spark)
    kept = materialize(exact_dedup.keep_one_per_text(docs, index), "kept-texts")
    index.drop()
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of similarity 0.8 on 5-word shingles, the smallest doc_id stays; documents without words all stay, of repeated rows one."""
    return near_dedup.keep_one_per_class(docs, width=5, percent=80)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens along the curve, with their token ids; an empty text is its separator alone, repeated rows are packed each."""
    return packing.pack(docs, TOKENIZER, PATTERN, length=1024, separator=0)
