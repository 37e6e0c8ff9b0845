"""Raw documents to token ids: quality, exact copies, near copies, mixture, encoding.

Defined results: every row is a document of its own, also if its doc_id is null or repeats; null texts count as empty and score what the
field gives a text without lines; of equal texts one row stays, and empty ones are equal; wordless rows have no near copies; a null
language or source is a leaf of its own; extra columns, whatever their names, pass through all stages but the last; very long texts are
read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe_prefix, exact_dedup, minhash, mixture, quality_crf
from tessella.llm.common import Scratch, table

#: The mixture takes documents once at most here: the stages before it have just removed repetition.
MIX = mixture.Mix(weights={("*", "en"): 4.0, ("*", "de"): 2.0, ("*", "fr"): 2.0, ("*", "es"): 2.0}, share=0.8, epochs=1, seed="pipeline")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go; it learns from the labelled rows of the stage's own input."""
    return quality_crf.keep_good(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs, minhash.Plan(words=5))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mixed(docs, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    import public_tokenizers
    from pyspark.sql import functions as F

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe_prefix.encode_documents(docs, path, public_tokenizers.PATTERN)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing to target weights", mix),
    ("byte-level BPE", encode),
]

#: A trained field and sketches stand in the way of SQL; tests/llm/test_pipeline.py holds each stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
