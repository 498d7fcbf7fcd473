"""A training-data pipeline: five stages, each on all that the one before kept, each written and read again.

SQL can't express the trained model, the draws and the packing, so there is no oracle; tests/llm/test_pipeline.py holds every
stage against what it must do on its own input (near duplicates, secrets, mix and pack by plain code) and run() against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import kneser_ney, mixing, ngram_join, packing, secrets
from spanloom.llm.common import read, stash
from spanloom.llm.queries import tokenizer_path

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text stays below their language's threshold."""
    return kneser_ney.kept_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle links connect."""
    return ngram_join.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets found in them replaced by a mark."""
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents, or the parts of them that were drawn, as often as they were."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else stash(docs, f"stage-{name}")
    return docs
