"""From raw documents to token shards: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.functions.tables import table
from starloom.llm import decontam, mixing, neardup, tokens, toxicity
from starloom.llm.queries import tokenizer_path
from starloom.plans.durable import durable


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 by the positive-unlabelled classifier, which is fitted on this stage's own input."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of every group of near-duplicates."""
    return neardup.keep_one(docs, percent=75, width=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies of each document that bring its source to its weight; every copy is a row."""
    return mixing.replicate(docs, exponent=0.5, epochs=1.0, seed=42)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mixture in doc_id order, and what they hold: one row per copy."""
    return tokens.token_output(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("toxicity", toxicity_stage),
    ("MinHash near-dedup", neardup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID output", token_stage),
]
#: Learned scores, singular vectors and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, f"stage{i}")
    return docs
