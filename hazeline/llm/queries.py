"""The registered queries of this package; their SQL twins are in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazeline.llm import alignment, bpe, captures, decontaminate, divergence, hardneg, htmlcrf, kneser, neardup, pii, substrings, toolcalls, toxicity
from hazeline.sources.tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality(table(spark, sf_dir, "documents"))


def op2_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_block_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcrf.extracted(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_merged_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    calls, results = toolcalls.calls_of(turns)
    rows = toolcalls.linked(calls, results, toolcalls.answer_schema(calls))
    return toolcalls.digests(rows.unionAll(toolcalls.plain_turns(turns)))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op11_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mined(table(spark, sf_dir, "embeddings"))


def op12_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.round_trip(table(spark, sf_dir, "pages"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.aligned(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ALIGNED))


QUERIES = {f.__name__: f for f in (op1_divergence, op2_superminhash, op3_byte_bpe, op4_decontamination, op5_block_crf, op6_toxicity,
                                  op7_merged_bwt, op8_tool_calls, op9_kneser_ney, op10_personal_data, op11_threshold, op12_capture_index,
                                  op13_alignment)}
