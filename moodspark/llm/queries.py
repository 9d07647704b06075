"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.llm import (decontaminate, edit_fingerprint, fill_middle, line_dedup, mixing, ngram_join, packing, pii, prefix_trie, secret_scan,
                           substring_dedup, token_count, toxicity, twins)
from moodspark.llm.common import sha256_hex, table


#: The query's key; a user gives their own.
PII_KEY = "surrogate key of the registered query"


def line_dedup_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its site."""
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cleaned.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
                          F.col("_kept").alias("text"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, 1024)


def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs found; a document without a row is clean."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_ngrams(table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def fill_middle_transformation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_hex(F.col("output")).alias("output_sha256"),
                      sha256_hex(fill_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def mixing_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents")).drop("times")


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup_by_site,
    "op2_token_counts": token_counts,
    "op3_best_fit_packing": best_fit_packing,
    "op4_secret_scans": secret_scans,
    "op5_suffix_array_dedup": suffix_array_dedup,
    "op6_benchmark_decontamination": benchmark_decontamination,
    "op7_document_fingerprints": document_fingerprints,
    "op8_ngram_jaccard_join": ngram_jaccard_join,
    "op9_toxicity": toxicity_scores,
    "op10_pii_surrogates": pii_surrogates,
    "op11_fill_in_middle": fill_middle_transformation,
    "op12_mixing_to_weights": mixing_to_weights,
    "op13_conversation_trie": conversation_trie,
}
ORACLE: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op4_secret_scans": secret_scan.ORACLE,
    "op5_suffix_array_dedup": twins.SUBSTRING_DEDUP,
    "op8_ngram_jaccard_join": twins.NGRAM_JOIN,
    "op11_fill_in_middle": fill_middle.ORACLE,
    "op12_mixing_to_weights": mixing.ORACLE,
}
