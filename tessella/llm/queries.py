"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_prefix, embed_dedup, exact_dedup, license_rules, line_dedup, minhash, mixture, quality_crf, token_store, toxicity_wfst
from .common import table


def op1_embedding_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_crf.score(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels")))


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Plan(words=4))


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.licences(table(spark, sf_dir, "documents")).select("doc_id", "n_matches", "licences", "matches")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store.store_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_toxicity_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_wfst.score(docs, toxicity_wfst.fit(docs, table(spark, sf_dir, "labels")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {("domain1",): 2.0, ("*", "en"): 4.0, ("*", "de"): 2.0, ("*", "*", "src0"): 0.5}
    return mixture.select(table(spark, sf_dir, "documents"), mixture.Mix(weights=weights))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_prefix.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_codes": op1_embedding_codes,
    "op2_quality_crf": op2_quality_crf,
    "op3_circulant_minhash": op3_circulant_minhash,
    "op4_line_spread": op4_line_spread,
    "op5_license_rules": op5_license_rules,
    "op6_token_store": op6_token_store,
    "op7_toxicity_wfst": op7_toxicity_wfst,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixture": op9_mixture,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op1_embedding_codes": embed_dedup.OP1_SQL,
    "op4_line_spread": line_dedup.OP4_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
}
