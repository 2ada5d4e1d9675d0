"""Registered queries of the operators: each over its whole table, with the operator's own parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rollmark.llm import mixing, phrases, sharding, spelling, urls
from rollmark.llm.decontam import benchmark_matches
from rollmark.llm.licenses import license_scan
from rollmark.llm.mixing import mix_plan, training_order
from rollmark.llm.ngram import lm_scores
from rollmark.llm.phrases import collocations
from rollmark.llm.sharding import shard_documents
from rollmark.llm.simhash import simhash_dedup
from rollmark.llm.spelling import spelling_variants
from rollmark.llm.spotsigs import edited_fingerprints
from rollmark.llm.substrings import substring_dedup
from rollmark.llm.tokens import token_output
from rollmark.llm.toxicity import toxicity
from rollmark.llm.urls import rules_table, url_filter

#: Words of the n-grams that the query learns; their disk use is told in the README.
LM_ORDER = 3
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the nested host and path rules for every page."""
    return url_filter(_table(spark, sf_dir, "pages"), rules_table(spark))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as entropy-coded blocks and read back."""
    return token_output(_table(spark, sf_dir, "documents"), TOKENIZER)


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited versions."""
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing 50-word windows that an earlier document has."""
    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_dedup(_table(spark, sf_dir, "documents"))


def op6_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text under a trigram model of the documents that aren't held out."""
    return lm_scores(_table(spark, sf_dir, "documents"), order=LM_ORDER)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, when they are due along the curriculum, and its place in the run."""
    return mix_plan(_table(spark, sf_dir, "documents"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When every pass of every document is due along the curriculum, and its place in the run."""
    return training_order(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by its nearest labelled examples."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return license_scan(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent word."""
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return shard_documents(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_token_output": op2_token_output,
    "op3_spotsigs": op3_spotsigs,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_ngram_scores": op6_ngram_scores,
    "op7_decontamination": op7_decontamination,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_sharding": op12_sharding,
    "op13_phrases": op13_phrases,
}

#: Further queries of an operator that has one in ``QUERIES``.
MORE: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_training_order": op8_training_order}

SQL: dict[str, str] = {
    "op1_url_filter": urls.SQL,
    "op8_mixing": mixing.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_sharding": sharding.SQL,
    "op13_phrases": phrases.SQL,
}
