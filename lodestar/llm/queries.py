"""The registered queries: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import op01_line_quality, op02_nn_descent, op03_brown_classes, op04_token_counts, op05_byte_bpe, op06_pii, op07_curve_packing, op08_cotraining, op09_gear_chunks
from lodestar.llm import op10_setsketch as setsketch
from lodestar.llm.common import scratch, table


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op01_line_quality.line_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "removed_lines")


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_brown_classes.score(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = op04_token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), scratch(spark, "token-cache"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return op05_byte_bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_curve_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_pii.find(table(spark, sf_dir, "documents"))


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_cotraining.co_train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_gear_chunks.repeated_spans(table(spark, sf_dir, "documents"))


def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), width=4, threshold=0.8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_quality": op1_line_quality,
    "op2_nn_descent": op2_nn_descent,
    "op3_brown_classes": op3_brown_classes,
    "op4_token_counts": op4_token_counts,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_pii": op6_pii,
    "op7_curve_packing": op7_curve_packing,
    "op8_cotraining": op8_cotraining,
    "op9_gear_chunks": op9_gear_chunks,
    "op10_setsketch": op10_setsketch,
}
SQL: dict[str, str] = {"op1_line_quality": op01_line_quality.SQL, "op2_nn_descent": op02_nn_descent.SQL}
