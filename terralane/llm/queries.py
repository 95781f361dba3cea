"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terralane.llm import (bpe, decontaminate, divergence, langid, oracles, passages, pii, quality, repeats, resample, secrets, simhash_dedup,
                           token_count, token_files)
from terralane.llm.common import scratch, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Operators that SQL can say in full; the others are held against brute force by the tests.
ORACLES: dict[str, str] = {"op11_importance_resampling": oracles.OP11, "op13_source_divergence": oracles.OP13}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_report(table(spark, folder, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"))


@query
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_file_report(table(spark, folder, "documents"), scratch(spark, "token-files"), _tokenizer("byte_bpe_50k.json"))


@query
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op5_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeat_report(table(spark, folder, "documents"))


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.count_tokens(table(spark, folder, "documents"), _tokenizer("byte_bpe_50k.json"))


@query
def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(table(spark, folder, "documents"))


@query
def op8_simhash_golay(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.simhash_components(table(spark, folder, "documents"))


@query
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data_report(table(spark, folder, "documents"))


@query
def op10_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.near_duplicate_passages(table(spark, folder, "documents"))


@query
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op12_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_report(table(spark, folder, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"))


@query
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(table(spark, folder, "documents"))
