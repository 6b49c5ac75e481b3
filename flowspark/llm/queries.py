"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import coder, codes, conversations, decontaminate, fingerprint, jaccard, pieces, pii, quality, repeats, shards, sql, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.extendible_shards(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op3_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coder.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_fingerprints(_table(spark, sf_dir, "documents"))


def op11_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_digest(repeats.remove_repeats(_table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes_digest(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_extendible_shards, op2_ngram_jaccard_join, op3_range_coded_ids, op4_sentencepiece, op5_quality,
        op6_token_counts, op7_decontaminate, op8_personal_data, op9_toxicity, op10_edit_fingerprints,
        op11_repeated_bytes, op12_prefix_trie, op13_vector_codes,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_extendible_shards": sql.EXTENDIBLE_SHARDS,
    "op2_ngram_jaccard_join": sql.NGRAM_JACCARD_JOIN,
    "op7_decontaminate": sql.DECONTAMINATE,
    "op11_repeated_bytes": sql.REPEATED_BYTES,
    "op12_prefix_trie": sql.PREFIX_TRIE,
    "op13_vector_codes": sql.PRODUCT_CODES,
}
