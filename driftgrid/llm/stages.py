"""The corpus pipeline's stages: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes
each stage's result as Parquet in shared scratch and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.llm import packing, pii, quality, simhash, substrings, tokens
from driftgrid.llm.columns import unused
from driftgrid.scratch import drop, materialize

#: Shortest repeated passage to go, in words.
PASSAGE = 50


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    (held,) = unused(docs, "__held")
    judged = quality.judge(docs).withColumn(held, F.monotonically_increasing_id())
    # The held column keeps the optimizer from pushing the filter, and with it all metrics, below their projections.
    return judged.where(F.col("kept") & (F.col(held) >= 0)).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near-duplicates."""
    return simhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of ``PASSAGE`` words or more that stand elsewhere too."""
    return substrings.dedup(docs, substrings.shortened, "text string, n_chars long", PASSAGE).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    clean = pii.detect(docs, redacted="text")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences."""
    cap = packing.Capacity()
    return packing.pack(packing.cut(docs, tokens.default_path(), cap.tokens), cap)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: Fingerprints, suffix trees and the tokenizer are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's input goes from the scratch folder once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if k:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
