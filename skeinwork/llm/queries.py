"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm import decontaminate, filter_audit, fingerprints, language_id, line_dedup, mixing, ngram_join, phrases, pii, quality, suffix_dedup, token_counts, token_io
from skeinwork.llm.common import prepared, table


def byte_bpe_path() -> str:
    """Where the public byte-level BPE vocabulary lies on this machine; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_io.tokenize(table(prepared(spark), sf_dir, "documents"), byte_bpe_path())


def byte_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(table(prepared(spark), sf_dir, "documents"), byte_ranks_path())


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(table(prepared(spark), sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(prepared(spark), sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(prepared(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(prepared(spark), sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(table(prepared(spark), sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(prepared(spark), sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digest(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_ids": op1_token_ids,
        "op2_token_counts": op2_token_counts,
        "op3_fingerprints": op3_fingerprints,
        "op4_language_id": op4_language_id,
        "op5_quality": op5_quality,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_ngram_join": op7_ngram_join,
        "op8_mixing": op8_mixing,
        "op9_pii": op9_pii,
        "op10_decontamination": op10_decontamination,
        "op11_line_dedup": op11_line_dedup,
        "op12_phrases": op12_phrases,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": mixing.ORACLE_SQL, "op10_decontamination": decontaminate.ORACLE_SQL, "op11_line_dedup": line_dedup.ORACLE_SQL, "op12_phrases": phrases.ORACLE_SQL, "op13_filter_audit": filter_audit.ORACLE_SQL}
