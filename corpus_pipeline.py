"""The corpus pipeline: the stages that turn the documents table into token counts.

Stages take (spark, docs, sf_dir) and return a frame; all but the last return the columns of docs. Statistics and
models that need labels or the benchmark read them from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazeline.llm import bpe, decontaminate, neardup, pii, toxicity
from hazeline.llm.queries import VOCABULARY
from hazeline.session import materialized
from hazeline.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return neardup.one_of_each_group(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule names go."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return pii.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what the other stages kept."""
    import public_tokenizers

    return bpe.tokenized(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("decontamination", drop_benchmark),
          ("personal_data", redact), ("byte_bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
